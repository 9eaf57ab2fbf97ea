"""Alignment against plain merging of whole texts, and counts against all documents."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from latticework.llm import alignment as M

ODD = [
    None, "", " ", "  ", "\n", "a", "▁", "a ▁ b", "é\U0001f600 x", "<|endoftext|> hi <s> </s> <unk> <0x41>", " x  y", "x \n y\t\tz ", " " * 3000, "\U0001f469‍\U0001f469‍\U0001f467" * 50,
    "中文字符" * 300, "it's don't 123 4567", "ﬁ ① ２", "\x00 a\x00b", "\x1c a \x1d b", "é x​ y", "﻿x", "ab" * 5000, "x\x85 y 　 z   w", "a  b  c » d",
]


@pytest.fixture(scope="module")
def aligner():
    with open(M.default_vocabulary(), encoding="utf-8") as a, open(M.default_pieces(), "rb") as b:
        return M.Aligner(a.read(), b.read())


def brute(aligner, text):
    """(n_a, n_b, n_groups, n_links, digest, links) by the libraries on the whole text and one pointer into each side."""
    spelt = lambda k, ids: [aligner.bytes[k][(f := int(aligner.first[k][i])) : f + int(aligner.size[k][i])].tobytes() for i in ids]
    none = (0, 0, 0, 0, "", Counter())
    if not text:
        return none
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    whole = (" " + text).encode()
    if b"".join(spelt(0, a)) != whole or b"".join(spelt(1, b)) != whole:
        return none
    ends = [np.cumsum([len(t) for t in spelt(k, ids)]).tolist() for k, ids in ((0, a), (1, b))]
    i = j = 0
    groups, links = [], Counter()
    for cut in sorted(set(ends[0]) & set(ends[1])):
        ga, gb = [], []
        while i < len(a) and ends[0][i] <= cut:
            ga.append(a[i])
            i += 1
        while j < len(b) and ends[1][j] <= cut:
            gb.append(b[j])
            j += 1
        groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        links.update((x, y) for x in ga for y in gb)
    return len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def got(aligner, texts):
    low = (1 << aligner.bits) - 1
    return [(d["n_a"], d["n_b"], d["n_groups"], d["n_links"], d["groups_sha256"], Counter({(k >> aligner.bits, k & low): n for k, n in zip(d["pairs"].tolist(), d["times"].tolist())})) for lot in aligner.aligned(iter(texts)) for d in lot]


def mixed(seed, many):
    rng = random.Random(seed)
    parts = ["a", "b ", " ", "  ", "\n", "é", "中", "\U0001f600", "'s", "1", ".", "token", " the", " align", "\x1f", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(many)]


@pytest.mark.parametrize("together, lane, listed", [(1 << 21, 512, 1 << 14), (300, 4, 2), (40, 1, 1)])
def test_odd_texts(aligner, monkeypatch, together, lane, listed):
    for name, value in (("TOGETHER", together), ("LANE", lane), ("LISTED", listed)):
        monkeypatch.setattr(M, name, value)
    texts = ODD + mixed(1, 400)
    found = got(aligner, texts)
    assert found == [brute(aligner, t) for t in texts]
    assert sum(x[0] > 0 for x in found) > 400 and sum(len(x[5]) > 3 for x in found) > 100


def test_texts_that_cannot_be_cut(aligner, monkeypatch):
    texts = ODD + mixed(2, 100)
    monkeypatch.setattr(aligner, "cuts", False)
    monkeypatch.setattr(aligner, "tokens", M.Tokens())
    monkeypatch.setattr(aligner, "ranks", None)
    assert got(aligner, texts) == [brute(aligner, t) for t in texts]


def test_lockstep_emits_links_and_cuts():
    # Two lanes: ends 2 5 6 | 9 and 1 5 6 | 7 9.
    cut_a, cut_b, a, b = M.lockstep(np.array([2, 5, 6, 9]), np.array([1, 5, 6, 7, 9]), np.array([0, 3]), np.array([0, 3]), np.array([3, 4]))
    assert cut_a.tolist() == [False, True, True, True] and cut_b.tolist() == [False, True, True, False, True]
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 3), (3, 4)]


def counted(aligner, ids, texts):
    """What the operator returns for each row, as often as it does."""
    each = [brute(aligner, t) for t in texts]
    docs_of = Counter(p for e in each for p in e[5])
    best = {}
    for (a, _), n in docs_of.items():
        best[a] = max(best.get(a, 0), n)
    return Counter((i, *e[:4], sum(n for p, n in e[5].items() if docs_of[p] == best[p[0]]), sum(n * docs_of[p] for p, n in e[5].items()), e[4]) for i, e in zip(ids, each))


def test_query_on_the_smallest_table(spark, aligner):
    from latticework.llm import queries as Q

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(tuple(r) for r in Q.op13_alignment(spark, sf).collect()) == counted(aligner, *zip(*rows))


def test_counts_over_all_documents(spark, aligner):
    texts = ODD + mixed(3, 60)
    texts += texts[-20:]
    ids = [None if k % 9 == 0 else k for k in range(len(texts))]
    expected = counted(aligner, ids, texts)
    docs = spark.createDataFrame([(i, t, 1, 2, "c") for i, t in zip(ids, texts)], "doc_id long, text string, id long, pair long, chunk string").repartition(3)
    found = M.align(docs)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == expected
    assert M.align(docs.limit(0)).count() == 0
