"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for each operator."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import bpe, exact_dedup, language_id, mixing, quality_classifier, quality_rules, repeats, simhash, url_filter, warc

LONG = " ".join(f"word{k % 977}" for k in range(60_000))
ROWS = [
    (1, "Some words of a text that is here, twice.", "en", "a", 1),
    (1, "Some words of a text that is here, twice.", "en", "a", 1),
    (2, "Some  words of a text\tthat is here, twice.", "en", None, 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "en", "b", 3),
    (None, "x", None, "b", 1),
    (None, "x", None, "b", 1),
    (6, LONG, "en", "c", 9),
    (7, "\u00e9\u4e2d\U0001f600 <|endoftext|> \x00 z", "fr", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, copies int, h string, fp double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 0, "h", 0.5) for r in ROWS], SCHEMA)


LABELS = [(1, 1, 0), (2, 0, 0), (4, None, 0), (None, 1, 1), (2, 1, 0), (6, 0, 0), (7, 1, 0)]
OPERATORS = {
    "quality": lambda d, s: quality_rules.quality(d),
    "simhash": lambda d, s: simhash.near_duplicates(d),
    "language": lambda d, s: language_id.identify(d),
    "mix": lambda d, s: mixing.mix(d),
    "repeats": lambda d, s: repeats.remove_repeats(d),
    "bpe": lambda d, s: bpe.bpe_round_trip(d),
    "exact": lambda d, s: exact_dedup.exact_dedup(d),
    "classifier": lambda d, s: quality_classifier.classify(d, s.createDataFrame(LABELS, "doc_id long, quality int, toxic int")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, docs, name):
    rows = OPERATORS[name](docs, spark).collect()
    assert len(rows) == len(ROWS)
    assert OPERATORS[name](docs.limit(0), spark).count() == 0


def test_exact_dedup_defined_results(docs):
    rows = exact_dedup.exact_dedup(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["text_sha256"], []).append(r)
    assert sorted(len(g) for g in by.values()) == [1, 1, 1, 2, 2, 3]
    assert all(sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)} for g in by.values())
    assert {r["keep_id"] for r in rows if r["doc_id"] in (1, 2)} == {1} and {r["keep_id"] for r in rows if r["doc_id"] in (3, 4)} == {3}


def test_exact_dedup_spills(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 6))) for _ in range(400)]
    rows = exact_dedup.exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table_bytes=200).collect()
    import re

    first, size = {}, {}
    for k, t in enumerate(texts):
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        first.setdefault(n, k)
        size[n] = size.get(n, 0) + 1
    for r in rows:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", texts[r["doc_id"]])
        assert (r["keep_id"], r["group_size"], r["kept"]) == (first[n], size[n], first[n] == r["doc_id"])


def test_exact_dedup_of_a_hot_text_above_the_table(spark):
    """Copies of one text from many tasks, of more bytes than the table; ids of text type."""
    hot = "hot words " * 50
    texts = [hot if k % 3 else f"text {k}" for k in range(300)]
    docs = spark.createDataFrame([(f"id{k:03d}", t) for k, t in enumerate(texts)], "doc_id string, text string").repartition(40)
    rows = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, table_bytes=600).collect()}
    assert len(rows) == 300 and all(rows[f"id{k:03d}"]["keep_id"] == (f"id{k:03d}" if k % 3 == 0 else "id001") for k in range(300))
    assert {r["group_size"] for r in rows.values()} == {1, 200} and sum(r["kept"] for r in rows.values()) == 101
    whole = exact_dedup.grouped(docs, rows=True, table_bytes=600).filter("leads").select("row.*").collect()
    assert sorted(r["doc_id"] for r in whole) == sorted(k for k, r in rows.items() if r["kept"])


def test_open_addressing_compares_contents():
    assert exact_dedup.distinct_slots(np.zeros(4, np.int64), [b"a", b"b", b"a", b"c"]).tolist() == [0, 1, 0, 3]


@pytest.mark.parametrize("spread", ["clusters", "even", "low bits"])
def test_simhash_links_against_all_pairs(spark, monkeypatch, spread):
    from latticework.operators.components import star_edges

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {
        "clusters": lambda: {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (25, 2))},
        "even": lambda: {int(x) << 50 | int(y) for x, y in rng.integers(0, 1 << 7, (400, 2))},
        "low bits": lambda: {int(x) for x in rng.integers(0, 1 << 12, 300)} | {2**64 - 1, 2**63, 0},
    }[spread]()
    fps = np.array(sorted(fps), np.uint64)
    rows = [(int(f), int(r)) for f, r in zip(fps.view(np.int64), simhash.gray_rank(fps).view(np.int64))]
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = simhash.forest(len(fps), [np.nonzero(np.triu(near, 1))[::-1]])
    expected = {}
    for f, k in zip(fps.view(np.int64).tolist(), label.tolist()):
        expected.setdefault(k, set()).add(f)
    for fan in (8, 2):
        monkeypatch.setattr(simhash, "FAN", fan)
        found = {}
        for r in star_edges(simhash.near_links(spark.createDataFrame(rows, "fp long, rank long"))).collect():
            found.setdefault(r["component"], {r["component"]}).add(r["id"])
        assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1) and found


def test_simhash_keeps_one_of_each(docs):
    kept = simhash.one_of_each(docs)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 6), (False, 7), (True, 0)]
    assert kept.columns == docs.columns and simhash.one_of_each(docs.limit(0)).count() == 0


CLASHING = ["key_id", "key_h", "key_rows", "key_source", "row", "col", "m", "a.b", "stay_id", "of_id", "text_hash", "component_id"]


def test_stages_take_clashing_names(spark):
    """Each stage with nulls, repeated rows and columns that are named like those the stages use inside."""
    import corpus_pipeline as P

    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text), (1, text), (2, text.replace("word7 ", "  word7\t")), (3, None), (None, text + " end"), (None, text + " end"), (4, text.replace("word", "term") + "\nclick here | now")]
    wide = spark.createDataFrame([(*r, "en", None if r[0] == 4 else "s", 7, *[str(k) for k, _ in enumerate(CLASHING)]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))
    for start in (wide, wide.limit(0)):
        for _, stage in P.STAGES[:-1]:
            whole = stage(spark, start, "")
            assert whole.columns == wide.columns and (whole.count() > 0) == (start is wide)
    docs = wide
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
    assert {r["doc_id"] for r in docs.collect()} <= {1, 4, None} and all(r["key_id"] == "0" and "click" not in r["text"] for r in docs.collect())


def test_mixed_takes_repeated_rows(spark):
    rows = [(k // 3, f"{'w ' * (k // 3)}", "a" if k % 2 else None) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda r: (r["doc_id"], r["source"])
    expected, got = {}, {}
    for r in mixing.mix(d).collect():
        expected[r["id"], r["source"]] = expected.get((r["id"], r["source"]), 0) + r["copies"]
    for r in mixing.mixed(d).collect():
        got[key(r)] = got.get(key(r), 0) + 1
    assert got == {k: n for k, n in expected.items() if n}


def test_mixing_targets(spark):
    rows = [(k, "w " * (1 + k % 7), "abcd"[k % 4] if k % 9 else None) for k in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    total = sum(r["size"] for r in got)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in got}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total) and all(t <= 2 * s + 1e-6 for t, s in targets.values())
    for source, (target, _) in targets.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == source) - target) <= 14
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.mix(d.repartition(7)).collect()
    assert sorted((r["id"], r["taken"]) for r in got) == sorted((r["id"], r["taken"]) for r in again)


def test_maximal_repeats_against_all_substrings():
    rng = random.Random(4)
    for _ in range(150):
        pieces = [bytes(rng.choice(b"ab\0" if rng.random() < 0.2 else b"ab") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5))]
        least, found = rng.randint(2, 5), {}
        subs: dict[bytes, list] = {}
        for k, p in enumerate(pieces):
            for i in range(len(p)):
                for j in range(i + least, len(p) + 1):
                    subs.setdefault(p[i:j], []).append((k, i))
        for s, where in subs.items():
            left = {(pieces[k][i - 1] if i else ("start", k, i)) for k, i in where}
            right = {(pieces[k][i + len(s)] if i + len(s) < len(pieces[k]) else ("end", k, i)) for k, i in where}
            if len(where) > 1 and len(left) > 1 and len(right) > 1:
                found[s] = sorted(where)
        assert {pieces[w[0][0]][w[0][1] : w[0][1] + n]: sorted(w) for n, w in repeats.maximal_repeats(pieces, least)} == found
        # A piece of several occurrences is a repeat as a whole.
        times = [rng.randint(1, 2) for _ in pieces]
        whole = {(len(p), k) for k, p in enumerate(pieces) if times[k] > 1 and len(p) >= least}
        assert {(n, w[0][0]) for n, w in repeats.maximal_repeats(pieces, least, times) if w[0][1] == 0 and n == len(pieces[w[0][0]])} >= whole


def test_repeats_without_own_ids(spark):
    from brute import removed

    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [word(260) for _ in range(5)]
    texts = [word(rng.randint(0, 300)) + (rng.choice(shared) if rng.random() < 0.5 else "") + word(rng.randint(0, 90)) for _ in range(200)]
    expected = sorted(removed(dict(enumerate(t.encode() for t in texts)), 200).values())
    for ids in ([None] * 200, [7] * 200, [f"a.{k % 3}" for k in range(200)]):
        kind = "string" if isinstance(ids[0], str) else "long"
        d = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], f"`doc.id` {kind}, text string, packed string")
        rows = repeats.remove_repeats(d, "doc.id").collect()
        assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == expected
        assert sorted(map(str, ids)) == sorted(str(r["doc.id"]) for r in rows)


def test_repeats_of_a_hot_passage(spark):
    from brute import removed

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 150)))
    passage = "".join(rng.choice("abcdefgh ") for _ in range(320))
    texts = {k: (word() + passage[: rng.choice((150, 230, 320))] + word() + ("aaaa " * rng.randint(0, 80))).encode() for k in range(60)}
    d = spark.createDataFrame([(k, t.decode()) for k, t in texts.items()], "doc_id long, text string")
    for contexts in (256, 4):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(d, contexts=contexts).collect()}
        assert got == removed(texts, 200)


def test_warc_round_trip_and_reruns(spark, tmp_path):
    page = "<p>" + "x" * 200
    rows = [(1, "http://a/", page), (2, None, page), (2, None, page), (3, "http://c/\r\nX: y", None), (4, "http://d/", ""), (5, "u", "short"), (6, "u", "short"), (None, "n", "é" * 90)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, size int")
    folders = [str(tmp_path / f) for f in "ab"]
    manifests = [sorted(tuple(r) for r in warc.write_archives(pages.repartition(n), f, shard_bytes=600, file_bytes=300).collect()) for n, f in zip((1, 3), folders)]
    assert manifests[0] == manifests[1] and len(manifests[0]) > 1 and sum(m[2] for m in manifests[0]) == len(rows)
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, folders[0]).collect()), key=str)
    assert got == sorted([(0, 180, "response", None), (1, 203, "response", None), (2, 203, "revisit", 1), (2, 203, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None)], key=str)
    assert warc.archive(pages.limit(0)).count() == 0


@pytest.mark.parametrize("ids", ["null", "one", "outlier"])
def test_warc_splits_heavy_bins(spark, tmp_path, ids):
    of = {"null": lambda k: None, "one": lambda k: 5, "outlier": lambda k: k or 1 << 60}[ids]
    pages = spark.createDataFrame([(of(k), f"u{k}", f"{k % 50} " * 100) for k in range(400)], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, str(tmp_path), shard_bytes=20_000, file_bytes=4000).collect()
    shards = {m["shard"] for m in manifest}
    assert len(shards) > 3 and max(sum(m["records"] for m in manifest if m["shard"] == s) for s in shards) < 200
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    if ids == "null":
        assert all(r["record_type"] == "response" for r in rows) and len(rows) == 400
    else:
        assert sum(r["record_type"] == "response" for r in rows) == 50 and len(rows) == 400
        first = {}
        for r in sorted(rows, key=lambda r: r["page_id"]):
            first.setdefault(r["payload_digest"], r["page_id"])
            assert r["refers_to"] in (None, first[r["payload_digest"]])
    # Files that no manifest names aren't read, and changed ones are found.
    (tmp_path / "part-99999999-00000.warc.gz").write_bytes(b"left over")
    assert warc.read_archives(spark, str(tmp_path)).count() == 400
    (tmp_path / manifest[0]["file"]).write_bytes(b"changed")
    with pytest.raises(Exception, match="manifest"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_warc_damage_is_found():
    data = bytearray(warc.record("response", 1, "u", b"payload" * 20, "0" * 64, None))
    with pytest.raises(ValueError):
        list(warc.records_of(warc.member(bytes(data))))


def test_urls_without_host(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.COM"), (4, "x://Www.Example.Com/en/1?q#f"), (5, "a://b.net/fr/"), (6, "a://net?x"), (7, "://"), (7, "://")]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(1, 8)] == [
        ("", "", None), ("", "", None), ("a.com", "", None), ("www.example.com", "/en/1", "www.example.com/en/"), ("b.net", "/fr/", "net/fr/"), ("net", "", None), ("", "", None),
    ]
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_bpe_words_scan_as_by_heap():
    codec = bpe._codec(open(bpe.default_vocabulary(), encoding="utf-8").read())
    rng = random.Random(8)
    words = [bytes(rng.choice(b"the inatonre ") for _ in range(rng.randint(1, 200))) for _ in range(300)] + [b"a", b"zzzz" * 40]
    start, count, ids = codec.merged(words)
    for word, a, n in zip(words, start.tolist(), count.tolist()):
        assert ids[a : a + n].tolist() == [codec.vocab[part] for part in codec._heaped(word)]


def test_bpe_odd_texts_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    rng = random.Random(9)
    parts = ["a", "the", " ", "  ", "\n", " \n", "\t", "'s", "'ll", "'", "<|endoftext|>", "\u00e9", "\u4e2d", "\U0001f600", "\0", "\x1c", "\u00a0", "1", "\u0662", "!", "...", "\u2028"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", " ", "x" * 1000, "ab " * 5000, "-" * 3000, LONG]
    codec = bpe._codec(open(bpe.default_vocabulary(), encoding="utf-8").read())
    for together in (1 << 20, 50):  # the second cuts texts and batches at every chance
        monkeypatch.setattr(bpe, "TOGETHER", together)
        for (n, ids, raw), found in zip(codec.coded(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert (n, ids.decode()) == (len(found.ids), ",".join(map(str, found.ids)))
            assert raw.decode("utf-8", "replace") == library.decode(found.ids, skip_special_tokens=False)


def test_bpe_unlike_words_of_one_hash(monkeypatch):
    codec = bpe._codec(open(bpe.default_vocabulary(), encoding="utf-8").read())
    right = list(codec.coded(["some words of some text"]))
    monkeypatch.setattr(bpe, "POWERS", np.zeros(1024, np.uint64))
    assert list(codec.coded(["some words of some text"])) == right


def test_viterbi_labels_spans():
    scores = np.array([[0.0, -9.0]] * 20 + [[-9.0, 0.0]] * 20 + [[0.0, -9.0]] * 2)
    assert language_id.viterbi(scores, 12.0).tolist() == [0] * 20 + [1] * 20 + [0] * 2
    assert language_id.viterbi(scores, 40.0).tolist()[:40] == [0] * 20 + [1] * 20
    assert language_id.viterbi(np.zeros((0, 2))).tolist() == []


def test_viterbi_against_all_paths():
    def value(scores, path, switch):
        return sum(scores[t][k] for t, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))

    rng = np.random.default_rng(2)
    cases = [np.array([[0.0, -36, -10], [-36, 0, -10]])] + [-rng.integers(0, 37, (rng.integers(1, 7), 3)).astype(float) for _ in range(600)]
    for scores in cases:
        best = max(value(scores, p, 12.0) for p in itertools.product(range(3), repeat=len(scores)))
        assert value(scores, language_id.viterbi(scores, 12.0).tolist(), 12.0) == best


def test_spans_of_mixed_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang")
    model = language_id.learn(docs)
    long = {r["lang"]: r["text"].split()[:60] for r in docs.filter("length(text) > 2000 and crc32(cast(cast(id as string) as binary)) % 5 = 0").collect()}
    right = n = 0
    for a, b in itertools.permutations(sorted(long), 2):
        path, _ = next(model.spans([" ".join(long[a] + long[b] + long[a]).encode()]))
        expected = [a] * 60 + [b] * 60 + [a] * 60
        right += sum(model.languages[k] == e for k, e in zip(path, expected))
        n += len(expected)
    assert len(long) > 2 and right >= 0.95 * n


def test_smallest_hashes_are_those_of_all_rows(spark):
    from latticework.llm.common import smallest_hashes

    ids = spark.createDataFrame([(k, "a" if k % 10 else "b") for k in range(4000)], "id long, g string")
    got = {(r["g"], r["place"]): r["id"] for r in smallest_hashes(ids, "g", 100).collect()}
    every = ids.select("id", "g", F.xxhash64("id").alias("h")).collect()
    for g in "ab":
        order = [r["id"] for r in sorted((r for r in every if r["g"] == g), key=lambda r: r["h"])]
        assert [got[g, k + 1] for k in range(100)] == order[:100]


def test_quality_counts(spark):
    text = "a b c d\n\na b c d\nx # y | z\n"
    r = quality_rules.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (13, 13, 2, 1, 8, True)


def test_viterbi_of_more_languages_than_a_byte_has():
    rng = np.random.default_rng(5)
    scores = rng.normal(size=(12, 300)) * 4
    path = language_id.viterbi(scores, 3.0)
    value = scores[0].copy()
    for row in scores[1:]:
        value = np.maximum(value, value.max() - 3.0) + row
    worth = scores[np.arange(12), path].sum() - 3.0 * (np.diff(path) != 0).sum()
    assert np.isclose(worth, value.max()) and path.max() > 128
