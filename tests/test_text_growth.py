"""Text documents whose lines must not gather in one task, and many documents that must not be as many files."""

from latticework import jobs
from latticework.sources import formats as FM
from latticework.sources import lines as L

SF = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entries_of_one_document_are_not_gathered_by_it(spark):
    plan = planned(jobs.queries()["src4_matrix_formats"](spark, SF))
    assert "hashpartitioning(doc" not in plan and "Window" not in plan


def test_numbers_with_lines_left_out_by_tasks_of_few_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "PIECE_BITS", 3)
    (tmp_path / "m").write_text("% first\n50 50 50\n" + "".join(("% note\n" * (k % 4)) + f"{k + 1} {k}\n" for k in range(50)))
    entries, _, faults = FM.matrix_read(L.lines_of(spark, str(tmp_path)), "sized")
    assert faults.isEmpty() and sorted((r.i, r.j, r.v) for r in entries.collect()) == [(k, k, float(k)) for k in range(50)]


def text_files(spark, what: str) -> set:
    from pathlib import Path
    from urllib.parse import urlparse

    from latticework.sources.scratch import shared_dir

    return set(Path(urlparse(shared_dir(spark)).path).glob(f"{what}-*/**/*.txt"))


def test_many_planar_graphs_share_files(spark):
    before = text_files(spark, "pslg")
    assert jobs.queries()["src3_pslg_text"](spark, SF).first()["vertices"] > 8 * 4
    assert 0 < len(text_files(spark, "pslg") - before) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_many_point_documents_share_files_and_a_user_may_be_null(spark, tmp_path):
    from latticework.sources import tables as T

    T.read(spark, SF, "events").selectExpr("event_id", "ts", "nullif(user_id, 3) as user_id", "value").write.parquet(str(tmp_path / "events.parquet"))
    before, p = text_files(spark, "points"), T.points_ev(spark, str(tmp_path))
    found = jobs.queries()["src2_points_text"](spark, str(tmp_path))
    assert sorted(map(str, found.collect())) == sorted(map(str, p.groupBy("user_id").agg({"*": "count", "x": "sum", "y": "sum"}).selectExpr("user_id", "`count(1)` as n", "round(`sum(x)`, 3) as sx", "round(`sum(y)`, 3) as sy").collect()))
    assert 0 < len(text_files(spark, "points") - before) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_mesh_sections_end_where_they_count_or_the_next_begins(spark, tmp_path, monkeypatch):
    (tmp_path / "m").write_text("# vtk\nmesh\nPOINTS 3 double\n0 0 0\n1 0 0\n0 1 0\nleft out\nCELLS 9 4\n3 0 1 2\nCELL_TYPES 1\n5\n")
    t = FM.mesh_read(L.lines_of(spark, str(tmp_path)))
    assert sorted((r.i, r.x, r.y) for r in t["node"].collect()) == [(0, 0, 0), (1, 1, 0), (2, 0, 1)]
    assert sorted((r.elem, r.pos, r.i) for r in t["elem"].collect()) == [(0, 0, 0), (0, 1, 1), (0, 2, 2)] and [(r.elem, r.type) for r in t["type"].collect()] == [(0, 5)]
    # No window over lines, and none over rows that are ranked.
    assert not any("Window" in planned(t[k]) for k in t)


def test_ranks_take_no_second_sort(spark):
    from pyspark.sql import functions as F

    from latticework.operators import graph as G

    r = G.ranked(spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), "id"), [F.col("v")])
    assert r.filter("rank <> v").isEmpty() and r.count() == 5000 and r.columns == ["v", "id", "rank"]
    assert "row_number" not in planned(r)


def test_matching_by_rounds_by_itself_and_by_both(spark, monkeypatch):
    import random

    from latticework.operators import graph as G

    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(300)} | {(k, k + 1) for k in range(100, 160)}
    edges = [(a, b, float(rng.randint(1, 3)) if a < 100 else 1.0) for a, b in pairs]
    used, taken = set(), set()
    for a, b, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if not {a, b} & used:
            used |= {a, b}
            taken.add((a, b, w))
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    # A path of equal weights is 30 rounds; what is left of 100 edges is not told by rounds.
    monkeypatch.setattr(G, "TASK_ROWS", 100)
    for sent in (0, 1000):
        monkeypatch.setattr(G, "SENT_ROWS", sent)
        assert {tuple(r) for r in G.greedy_matching(df, most_rounds=8).collect()} == taken
    assert G.greedy_matching(df.filter("w > 9")).isEmpty()


def matched(edges: list) -> set:
    used, taken = set(), set()
    for a, b, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if not {a, b} & used:
            used |= {a, b}
            taken.add((a, b, w))
    return taken


def test_matching_of_equal_weights_takes_no_round_for_each_link_of_a_chain(spark, monkeypatch):
    import random

    from latticework.operators import graph as G

    rng = random.Random(5)
    edges = [(k, k + 1, 1.0) for k in range(80)] + [(a, b, w) for (a, b), w in {tuple(sorted(rng.sample(range(60, 120), 2))): float(rng.randint(1, 2)) for _ in range(120)}.items() if b - a > 1]
    df = spark.createDataFrame(rng.sample(edges, len(edges)), "src long, dst long, w double")
    monkeypatch.setattr(G, "TASK_ROWS", 12)
    monkeypatch.setattr(G, "PASS_ROWS", 40, raising=False)
    # Rounds of edges that are the best at both ends would be about forty.
    for sent, share in ((0, 0.0), (25, 1.1), (1000, 0.5)):
        monkeypatch.setattr(G, "SENT_ROWS", sent)
        monkeypatch.setattr(G, "PASS_SHARE", share, raising=False)
        assert {tuple(r) for r in G.greedy_matching(df, most_rounds=12).collect()} == matched(edges)


def test_matching_of_weights_that_differ_goes_by_rounds_first(spark, monkeypatch):
    import random

    from latticework.operators import graph as G

    rng = random.Random(7)
    edges = [(a, b, rng.random() + 0.1) for a, b in {tuple(sorted(rng.sample(range(90), 2))) for _ in range(500)}] + [(200, 201, float("nan")), (201, 202, float("inf"))]
    df, passed = spark.createDataFrame(edges, "src long, dst long, w double"), []
    monkeypatch.setattr(G, "TASK_ROWS", 20)
    monkeypatch.setattr(G, "PASS_ROWS", 60)
    monkeypatch.setattr(G, "in_passes", lambda left, held, most, run=G.in_passes: passed.append(held) or run(left, held, most))
    want = {r[:2] for r in matched([(a, b, 9.0 if a == 200 else w) for a, b, w in edges if a != 201])}
    for share in (0.25, 1.0):
        monkeypatch.setattr(G, "ROUND_SHARE", share)
        assert {(r.a, r.b) for r in G.greedy_matching(df).collect()} == want
    # Without rounds that pay, more is left for passes.
    assert passed[0] <= 60 < passed[1]
