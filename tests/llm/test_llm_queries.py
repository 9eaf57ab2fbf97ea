"""The queries opN_ and the pipeline on the smallest tables: SQL where there is one, else brute force or invariants."""

import hashlib
from collections import defaultdict
from pathlib import Path

import pytest
from brute import cleaned, components, fingerprint, removed, stays
from oracle import same
from pyspark.sql import functions as F

from latticework.llm import queries as Q
from latticework.llm import url_filter

SF = "/root/testdata/sf0.001"
QUERIES, SQL = Q.queries(), Q.oracle_sql()


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], SF)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_simhash_against_brute_force(spark):
    got = {r["doc_id"]: r for r in QUERIES["op3_simhash"](spark, SF).collect()}
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in table(spark, "documents").collect()}
    assert {k: int(r["fingerprint"], 16) for k, r in got.items()} == prints
    assert {k: r["component_id"] for k, r in got.items()} == components(prints)


def test_suffix_dedup_against_brute_force(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, "documents").collect()}
    expected = removed(docs, 200)
    for r in QUERIES["op6_suffix_dedup"](spark, SF).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]]


def test_bpe_against_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "documents").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in QUERIES["op7_bpe"](spark, SF).collect():
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(tokenizer.decode(ids, skip_special_tokens=False))


LARGER = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op4_language_id"](spark, LARGER).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_quality_held_out(spark):
    """Both labels are found, so a constant answer gives 0.5 here."""
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op10_quality_classifier"](spark, LARGER).collect() if r["held_out"] and r["doc_id"] in quality]
    share = [[r["predicted"] == y for r in rows if quality[r["doc_id"]] == y] for y in (0, 1)]
    assert min(map(len, share)) >= 10 and sum(sum(s) / len(s) for s in share) / 2 >= 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_url_model_held_out(spark):
    """Of the urls that a rule decides, a quarter is judged by a model that learned from the others."""
    urls = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select(url_filter.host_and_path(F.col("url")).alias("u")).select("u.*")
    known = urls.withColumn("r", url_filter.rule_of(F.col("host"), F.col("path"))).filter("r is not null").select("host", "path", (F.col("r.verdict") == "block").cast("int").alias("label")).distinct()
    known = known.select("label", url_filter.features(F.col("host"), F.col("path")).alias("buckets"), F.pmod(F.xxhash64("path", "host"), F.lit(4)).alias("fold")).cache()
    weights, bias = url_filter.train(known.filter("fold > 0").select("buckets", "label").coalesce(1).cache())
    rows = known.filter("fold = 0").select("label", (url_filter.chance(F.col("buckets"), weights, bias) >= 0.5).cast("int").alias("p")).collect()
    share = [[r["p"] == y for r in rows if r["label"] == y] for y in (0, 1)]
    assert min(map(len, share)) >= 20 and sum(sum(s) / len(s) for s in share) / 2 >= 0.9


def test_url_rules_against_a_loop(spark):
    urls = {r["page_id"]: r["url"] for r in table(spark, "pages").collect()}
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    rows = QUERIES["op2_url_filter"](spark, SF).collect()
    assert len(rows) == len(urls)
    for r in rows:
        rest = (urls[r["page_id"]] or "").partition("://")[2]
        host = rest
        for c in "/?#":
            host = host.partition(c)[0]
        path = rest[len(host) :].partition("?")[0].partition("#")[0]
        assert (r["host"], r["path"]) == (host.lower(), path)
        fits = [(len(h + p), v, h + p) for v, h, p in rules if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
        if fits:
            assert (r["verdict"], r["rule"]) == max(fits)[1:]
        else:
            assert r["rule"] is None and r["verdict"] in ("allow", "block")


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = before = table(spark, "documents")
    columns = docs.columns
    found = {}
    for name, stage in P.STAGES:
        docs = found[name] = stage(spark, docs, SF).cache()
        assert docs.columns == columns or name == P.STAGES[-1][0]
    kept = {r["doc_id"] for r in QUERIES["op1_quality_rules"](spark, SF).filter("kept").collect()}
    assert {r["doc_id"] for r in found["quality_rules"].collect()} == kept
    texts = {r["doc_id"]: cleaned(r["text"]) for r in before.collect() if r["doc_id"] in kept}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in found["quality_rules"].collect()} == {k: (t, len(t)) for k, t in texts.items()}
    assert any(texts[r["doc_id"]] != r["text"] for r in before.collect() if r["doc_id"] in kept)
    first = {}
    for k in sorted(texts):
        first.setdefault(b" ".join((b"|" + texts[k].encode() + b"|").split()), k)
    assert {r["doc_id"] for r in found["exact_dedup"].collect()} == set(first.values())
    stay = stays({k: texts[k] for k in first.values()})
    assert sorted(r["doc_id"] for r in found["simhash_dedup"].collect()) == sorted(stay)
    copies = defaultdict(int)
    for r in found["mixing"].collect():
        copies[r["doc_id"]] += 1
    assert max(copies.values()) <= 2 and set(copies) <= stay
    assert sorted(r["doc_id"] for r in found["bpe"].collect()) == sorted(k for k, n in copies.items() for _ in range(n))
    assert P.ORACLE_SQL is None and Path(P.__file__).name == "corpus_pipeline.py"
