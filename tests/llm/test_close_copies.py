"""The pipeline's near-duplicate stage against all pairs of five-word shingle sets."""

import random

from brute import components, fingerprint, stays

from latticework.llm import close_copies


def made():
    rng = random.Random(11)
    words = [f"word{k}" for k in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    notice = text(40)
    texts = [text(rng.randint(4, 120)) for _ in range(40)]
    for base in texts[:20]:  # copies of few to many edits, some beyond the bound
        for edits in (1, 2, 4, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    large = text(150)
    texts += [large[:k] + ["new"] + large[k + 1 :] for k in range(0, 150, 2)]  # a large group of copies
    texts += [notice + text(rng.randint(1, 14)) for _ in range(90)]  # a common passage, a group that stays apart in part
    return {k: " ".join(t) for k, t in enumerate(texts)}


def test_stage_links_close_copies_as_all_pairs_do(spark, monkeypatch):
    import corpus_pipeline as P

    texts = made()
    expected = stays(texts)
    assert len(expected) < len(set(components({k: fingerprint(t) for k, t in texts.items()}).values()))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stage = dict(P.STAGES)["simhash_dedup"]
    assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == expected
    # The same by several rounds, a few texts of each shingle at a time.
    monkeypatch.setattr(close_copies, "PAIRS", 1)
    monkeypatch.setattr(close_copies, "FIRST", 1)
    assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == expected


def test_close_copies_without_ids(spark):
    import corpus_pipeline as P

    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(None, text), (None, text.replace("word30", "other")), (None, "a b")], "doc_id long, text string")
    assert dict(P.STAGES)["simhash_dedup"](spark, docs, "").count() == 2
