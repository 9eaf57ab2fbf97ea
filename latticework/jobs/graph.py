"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.jobs.registry import query
from latticework.operators import graph as G
from latticework.operators.components import connected_components
from latticework.sources import tables as T
from latticework.sources.tables import r6, sql


@query(sql("SELECT DISTINCT src, dst FROM edges_sym"))
def gra1_force_symmetry(spark: SparkSession, d: str) -> DataFrame:
    return G.force_symmetry(T.edges_pp(spark, d), 2 * T.edge_tasks(spark, d))


@query(sql("""WITH two AS (SELECT src, dst, w FROM edges_sym WHERE w >= 3), f AS (SELECT a.src, b.dst, arg_min(a.w + b.w, a.dst) AS w FROM two a JOIN two b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY 1, 2)
    SELECT * FROM two UNION ALL SELECT f.* FROM f ANTI JOIN two USING (src, dst)"""))
def gra2_extend_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return G.extend_adjacency(T.edges_sym(spark, d).filter("w >= 3"), 1)


@query(sql("SELECT src, dst, w FROM edges_sym WHERE src % 4 = 1 AND dst % 4 = 1"))
def gra3_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return G.induced(T.edges_sym(spark, d), T.parts_of(spark, d).filter("part = 1"))


@query(sql("SELECT i, j, v FROM coo WHERE i IN (SELECT i FROM coo GROUP BY i HAVING count(*) BETWEEN 10 AND 40)"))
def gra4_prune(spark: SparkSession, d: str) -> DataFrame:
    m = T.coo(spark, d)
    return m.join(m.groupBy("i").count().filter("count between 10 and 40").select("i"), "i", "left_semi").select("i", "j", "v")


CC = """cc(id, comp) USING KEY (id) AS (SELECT DISTINCT src, src FROM {0} UNION SELECT e.dst, min(c.comp) FROM cc c JOIN {0} e ON e.src = c.id JOIN recurring.cc r ON r.id = e.dst WHERE c.comp < r.comp GROUP BY e.dst)"""


@query(sql(f"WITH RECURSIVE strong AS (SELECT src, dst FROM edges_sym WHERE w >= 3), {CC.format('strong')} SELECT id, comp AS component FROM cc"))
def gra5_connected_components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(T.edges_pp(spark, d).filter("w >= 3"))


@query(sql("WITH RECURSIVE f(id, level) AS (SELECT min(src), 0 FROM edges_sym UNION SELECT e.dst, f.level + 1 FROM f JOIN edges_sym e ON e.src = f.id WHERE f.level < 8) SELECT id, CAST(min(level) AS INTEGER) AS level FROM f GROUP BY id"))
def gra6_bfs(spark: SparkSession, d: str) -> DataFrame:
    e = T.stored_once(T.edges_sym(spark, d))
    return G.bfs(e, e.agg(F.min("src").alias("id")))


def _order_sql(levels: int) -> str:
    """A level after another; each numbers its vertices after all before it."""
    out = ["l0 AS (SELECT min(src) AS id, 0 AS level, CAST(0 AS BIGINT) AS place FROM edges_sym)", "s0 AS (SELECT * FROM l0)"]
    for k in range(1, levels + 1):
        out.append(f"l{k} AS (SELECT id, {k} AS level, (SELECT count(*) FROM s{k - 1}) + row_number() OVER (ORDER BY parent, id) - 1 AS place FROM (SELECT dst AS id, min(place) AS parent FROM l{k - 1} JOIN edges_sym ON src = id WHERE dst NOT IN (SELECT id FROM s{k - 1}) GROUP BY dst))")
        out.append(f"s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM l{k})")
    return "WITH " + ", ".join(out) + f" SELECT id, CAST(level AS INTEGER) AS level, CAST(place AS BIGINT) AS place FROM s{levels}"


@query(sql(_order_sql(9)))
def gra6_bfs_order(spark: SparkSession, d: str) -> DataFrame:
    e = T.stored_once(T.edges_sym(spark, d))
    return G.bfs_order(e, e.agg(F.min("src").alias("id")))


@query(sql("""WITH RECURSIVE s(id, cost) USING KEY (id) AS (SELECT min(src), 0.0::DOUBLE FROM edges_sym UNION
    SELECT e.dst, min(s.cost + 1/e.w) FROM s JOIN edges_sym e ON e.src = s.id LEFT JOIN recurring.s r ON r.id = e.dst WHERE r.cost IS NULL OR s.cost + 1/e.w < r.cost GROUP BY e.dst) SELECT id, round(cost, 6) AS cost FROM s"""))
def gra7_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    e = T.stored_once(T.edges_sym(spark, d).withColumn("w", 1 / F.col("w")))
    return G.shortest_paths(e, e.agg(F.min("src").alias("id"))).select("id", F.round("cost", 6).alias("cost"))


@query()
def gra8_greedy_matching(spark: SparkSession, d: str) -> DataFrame:
    return G.greedy_matching(T.edges_pp(spark, d))


@query(sql("SELECT src AS i, dst AS j, -w AS v FROM edges_sym UNION ALL SELECT src, src, round(sum(w) + 1e-9, 9) FROM edges_sym GROUP BY src"))
def gra9_laplacian(spark: SparkSession, d: str) -> DataFrame:
    return G.laplacian(T.edges_sym(spark, d)).select("i", "j", F.round("v", 9).alias("v"))


@query(sql("""WITH x AS (SELECT e.*, e.src % 4 AS a, e.dst % 4 AS b FROM edges_sym e WHERE e.src % 4 <> e.dst % 4) SELECT (SELECT sum(w)/2 FROM x) AS cut, (SELECT count(*) FROM (SELECT DISTINCT src, b FROM x)) AS volume,
    (SELECT max(c) FROM (SELECT sum(w) AS c FROM x GROUP BY a)) AS most_cut"""))
def gra11_cut_quality(spark: SparkSession, d: str) -> DataFrame:
    return G.cut_quality(T.edges_sym(spark, d), T.parts_of(spark, d))


@query(sql("SELECT round(count(*) * max(s) / sum(s), 6) AS balance FROM (SELECT src % 4 AS part, sum(w) AS s FROM edges_sym GROUP BY 1)"))
def gra12_partition_balance(spark: SparkSession, d: str) -> DataFrame:
    return G.balance(T.edges_sym(spark, d).withColumn("part", F.col("src") % 4)).select(r6(F.col("balance")).alias("balance"))


@query(sql("SELECT i AS src, j AS dst FROM spd WHERE i <> j"))
def gra13_matrix_graph(spark: SparkSession, d: str) -> DataFrame:
    return T.spd(spark, d).filter("i <> j").select(F.col("i").alias("src"), F.col("j").alias("dst"))


@query(sql("""WITH p AS (SELECT src AS a, dst AS b FROM edges_pp WHERE w >= 2) SELECT p.a, p.b, CAST(count(y.src) AS BIGINT) AS n FROM p LEFT JOIN edges_sym x ON x.src = p.a LEFT JOIN edges_sym y ON y.src = p.b AND y.dst = x.dst GROUP BY 1, 2"""))
def set4_common_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return G.common_neighbours(T.edges_sym(spark, d), T.edges_pp(spark, d).filter("w >= 2").select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query(sql("SELECT src AS id, CAST(count(*) AS BIGINT) AS degree, sum(w) AS weight FROM edges_sym GROUP BY 1"))
def agg14_degree(spark: SparkSession, d: str) -> DataFrame:
    return T.edges_sym(spark, d).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("w").alias("weight"))


@query(sql("SELECT (src * 7 + 3) % 1000003 AS src, (dst * 7 + 3) % 1000003 AS dst, w FROM edges_pp"))
def srt6_relabel(spark: SparkSession, d: str) -> DataFrame:
    perm = T.parts_of(spark, d).select(F.col("id").alias("old"), ((F.col("id") * 7 + 3) % 1000003).alias("new"))
    return G.relabel(T.edges_pp(spark, d), perm, ["src", "dst"]).select("src", "dst", "w")
