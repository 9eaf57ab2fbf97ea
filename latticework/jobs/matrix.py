"""Queries of sparse matrices, row similarity and itemsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.jobs.registry import query
from latticework.operators import itemsets as I
from latticework.operators import sparse as S
from latticework.sources import tables as T
from latticework.sources.tables import r6, sql


def _x(spark: SparkSession, d: str) -> DataFrame:
    return T.vec_x(spark, d).select(F.col("j").alias("i"), "x")


@query("SELECT round(sqrt(sum(x*x)), 4) AS norm, round(sum(x), 4) AS total, max(x) AS most, arg_max(i, (x, -i)) AS at, round(sum(x*z), 4) AS dot FROM (SELECT p_partkey AS i, round(p_retailprice/1000, 6) AS x, p_size AS z FROM part)")
def agg8_vector(spark: SparkSession, d: str) -> DataFrame:
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("i"), F.round(F.col("p_retailprice") / 1000, 6).alias("x"), F.col("p_size").alias("z"))
    at = F.max_by("i", F.struct("x", (-F.col("i")).alias("o")))
    return p.agg(F.round(F.sqrt(F.sum(F.expr("x*x"))), 4).alias("norm"), F.round(F.sum("x"), 4).alias("total"), F.max("x").alias("most"), at.alias("at"), F.round(F.sum(F.expr("x*z")), 4).alias("dot"))


@query("SELECT i, x FROM (SELECT p_partkey AS i, round(p_retailprice/1000, 6) AS x FROM part) ORDER BY x DESC, i LIMIT 1 OFFSET 6")
def agg8_nth_largest(spark: SparkSession, d: str) -> DataFrame:
    """Where the seventh largest entry of a vector is, ties by index."""
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("i"), F.round(F.col("p_retailprice") / 1000, 6).alias("x"))
    return S.nth_largest(p, 7)


@query(sql("SELECT 'row' AS what, i AS id, sum(v) AS s, sum(v*v) AS q FROM coo GROUP BY i UNION ALL SELECT 'col', j, sum(v), sum(v*v) FROM coo GROUP BY j"))
def agg10_row_col_sums(spark: SparkSession, d: str) -> DataFrame:
    m = T.coo(spark, d)
    of = lambda what, c: m.groupBy(F.lit(what).alias("what"), F.col(c).alias("id")).agg(F.sum("v").alias("s"), F.sum(F.expr("v*v")).alias("q"))
    return of("row", "i").unionByName(of("col", "j"))


@query(sql("SELECT (SELECT count(*) FROM coo) AS nnz, (SELECT round(sqrt(sum(v*v)), 4) FROM coo) AS frobenius, (SELECT round(sqrt(sum((a.v-coalesce(b.v, 0))*(a.v-coalesce(b.v, 0))) FILTER (a.i > a.j) + sum(a.v*a.v) FILTER (a.i < a.j AND b.v IS NULL)), 4) FROM coo a LEFT JOIN coo b ON a.i = b.j AND a.j = b.i) AS asymmetry"))
def agg11_norms(spark: SparkSession, d: str) -> DataFrame:
    m = T.coo(spark, d)
    one = m.agg(F.count("*").alias("nnz"), F.round(F.sqrt(F.sum(F.expr("v*v"))), 4).alias("frobenius"))
    return one.join(S.asymmetry(m).select(F.round("norm", 4).alias("asymmetry")), F.lit(True))


@query(sql("SELECT q.i, q.j, coalesce(m.v, 0) AS v FROM (SELECT DISTINCT i, (i*7) % 2000 AS j FROM coo) q LEFT JOIN coo m USING (i, j)"))
def lin1_get_entries(spark: SparkSession, d: str) -> DataFrame:
    m = T.coo(spark, d)
    return m.select("i", (F.col("i") * 7 % 2000).alias("j")).distinct().join(m, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


@query(sql("SELECT i, j, sum(v) AS v FROM (SELECT i, j, 2.0*v AS v FROM coo UNION ALL SELECT j, i, v FROM coo) GROUP BY i, j"))
def lin2_scale_add(spark: SparkSession, d: str) -> DataFrame:
    m = T.coo(spark, d)
    return S.added(m.select("i", "j", (2.0 * F.col("v")).alias("v")), S.transpose(m))


@query(sql("SELECT j AS i, i AS j, v FROM coo"))
def lin3_transpose(spark: SparkSession, d: str) -> DataFrame:
    return S.transpose(T.coo(spark, d))


@query(sql("SELECT i, round(sum(v*x), 4) AS x FROM coo JOIN vec_x USING (j) GROUP BY i"))
def lin4_spmv(spark: SparkSession, d: str) -> DataFrame:
    return S.spmv(T.coo(spark, d), _x(spark, d)).select("i", F.round("x", 4).alias("x"))


@query(sql("SELECT i, j, CASE WHEN i % 10 <> 0 THEN v WHEN i = j THEN 1.0 ELSE 0.0 END AS v FROM spd"))
def lin5_identity_rows(spark: SparkSession, d: str) -> DataFrame:
    return T.spd(spark, d).select("i", "j", F.when(F.col("i") % 10 != 0, F.col("v")).when(F.col("i") == F.col("j"), 1.0).otherwise(0.0).alias("v"))


@query()
def lin6_power_iteration(spark: SparkSession, d: str) -> DataFrame:
    """The largest eigenvalue's vector, with the residual of its equation in each row."""
    m = T.stored_once(T.spd(spark, d))
    (value,), (q,) = S.power_iteration(m, 1, 1e-3, 40)
    y = S.spmv(m, q).withColumnRenamed("x", "y")
    return q.join(y, "i").select("i", "x", F.lit(value).alias("eigenvalue"), (F.col("y") - value * F.col("x")).alias("residual"))


@query(sql("""WITH f AS (SELECT DISTINCT i FROM spd WHERE i % 10 = 0), b AS (SELECT i, 1.0 AS x FROM (SELECT DISTINCT i FROM spd))
    SELECT i, round(sum(x), 6)+0.0 AS x FROM (SELECT i, x FROM b WHERE i NOT IN (SELECT i FROM f) UNION ALL SELECT s.i, -s.v*2.0 FROM spd s JOIN f ON s.j = f.i WHERE s.i NOT IN (SELECT i FROM f) UNION ALL SELECT i, 2.0 FROM f) GROUP BY i"""))
def lin7_dirichlet(spark: SparkSession, d: str) -> DataFrame:
    m = T.spd(spark, d)
    ids = m.select("i").distinct()
    _, rhs = S.dirichlet(m, ids.select("i", F.lit(1.0).alias("x")), ids.filter("i % 10 = 0").select("i", F.lit(2.0).alias("value")))
    return rhs.select("i", r6(F.col("x")).alias("x"))


@query()
def lin8_conjugate_gradient(spark: SparkSession, d: str) -> DataFrame:
    """The solution of the graph's system, with each row's residual."""
    m = T.stored_once(T.spd(spark, d))
    b = T.stored_once(m.select("i").distinct().select("i", (F.col("i") % 7 - 3.0).alias("x")))
    x, steps, _ = S.conjugate_gradient(m, b, 1e-6)
    r = S.spmv(m, x).select("i", F.col("x").alias("ax")).join(b.select("i", F.col("x").alias("b")), "i")
    return x.join(r, "i").select("i", "x", F.lit(steps).alias("steps"), (F.col("b") - F.col("ax")).alias("residual"))


@query()
def lin9_lanczos(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of the spectrum of the graph's matrix, beside Gershgorin's."""
    m = T.stored_once(T.spd(spark, d))
    low, high = S.lanczos(m, 10)
    rows = m.groupBy("i").agg(F.sum(F.when(F.expr("i = j"), F.col("v"))).alias("d"), F.sum(F.when(F.expr("i <> j"), F.abs("v")).otherwise(0.0)).alias("r"))
    return rows.agg(F.min(F.col("d") - F.col("r")).alias("gershgorin_low"), F.max(F.col("d") + F.col("r")).alias("gershgorin_high")).withColumns({"low": F.lit(low), "high": F.lit(high)})


JAC = "SELECT b.i, (b.x - coalesce(s.s, 0)) / d.v AS x FROM b JOIN spd d ON d.i = b.i AND d.j = b.i LEFT JOIN (SELECT a.i, sum(a.v*p.x) AS s FROM spd a JOIN {0} p ON p.i = a.j WHERE a.i <> a.j GROUP BY a.i) s ON s.i = b.i"


@query(sql(f"WITH b AS (SELECT DISTINCT i, i % 7 - 3.0 AS x FROM spd), z AS (SELECT i, 0.0 AS x FROM b), s1 AS ({JAC.format('z')}), s2 AS ({JAC.format('s1')}), s3 AS ({JAC.format('s2')}) SELECT i, round(x, 8)+0.0 AS x FROM s3"))
def lin10_jacobi(spark: SparkSession, d: str) -> DataFrame:
    m = T.stored_once(T.spd(spark, d))
    b = m.select("i").distinct().select("i", (F.col("i") % 7 - 3.0).alias("x"))
    return S.jacobi_sweeps(m, b, 3).select("i", (F.round("x", 8) + 0.0).alias("x"))


@query(sql("WITH n AS (SELECT greatest(max(i), max(j)) + 1 AS n FROM coo), c AS (SELECT CAST(floor(i/(n/20.0)) AS BIGINT) AS r, CAST(floor(j/(n/20.0)) AS BIGINT) AS c, count(*) AS k FROM coo, n GROUP BY 1, 2) SELECT r, c, round(k / max(k) OVER (), 6) AS share FROM c"))
def lin11_density_map(spark: SparkSession, d: str) -> DataFrame:
    m = T.coo(spark, d)
    n = m.agg(F.greatest(F.max("i"), F.max("j")) + 1).first()[0]
    return S.density_map(m, n, 20).select("r", "c", F.round("share", 6).alias("share"))


UNIT = "u AS (SELECT i, j, v / sqrt(sum(v*v) OVER (PARTITION BY i)) AS v FROM coo)"


@query(sql(f"WITH {UNIT} SELECT i, j, round(v, 8) AS v FROM u"))
def txt1_normalize(spark: SparkSession, d: str) -> DataFrame:
    return S.normalised(T.coo(spark, d), 2).select("i", "j", F.round("v", 8).alias("v"))


@query(sql("""WITH n AS (SELECT count(*) AS n FROM customer), f AS (SELECT j, count(*) AS df FROM coo GROUP BY j), b AS (SELECT greatest(10, floor(0.5*count(*)/count(DISTINCT j))) AS b FROM coo)
    SELECT i, j, round(0.5+0.5*v/max(v) OVER (PARTITION BY i), 6) AS maxtf, round(0.1+pow(v, 0.5), 6) AS sq, round(1+log2(v), 6) AS lg, round(v*ln(n/df), 6) AS idf, round(v*ln((n+2*b)/(b+df)), 6) AS idf2 FROM coo JOIN f USING (j), n, b"""))
def txt2_scale(spark: SparkSession, d: str) -> DataFrame:
    m, n = T.stored_once(T.coo(spark, d)), T.read(spark, d, "customer").count()
    out = m.select("i", "j")
    for name, kind in (("maxtf", "MAXTF"), ("sq", "SQRT"), ("lg", "LOG"), ("idf", "IDF"), ("idf2", "IDF2")):
        out = out.join(S.scaled(m, kind, n).select("i", "j", F.round("v", 6).alias(name)), ["i", "j"])
    return out


def _sim_sql(value: str) -> str:
    return f"round(coalesce(({value}), 0), 6)"


@query(sql("""WITH s AS (SELECT i, sum(v) AS s, sum(v*v) AS q FROM coo GROUP BY i), p AS (SELECT a.i AS a, b.i AS b, a.s AS sa, b.s AS sb, a.q AS qa, b.q AS qb FROM s a JOIN s b ON b.i = a.i + 1),
    m AS (SELECT x.i AS a, y.i AS b, sum(x.v*y.v) AS dot, sum(least(x.v, y.v)) AS l FROM coo x JOIN coo y ON y.i = x.i + 1 AND x.j = y.j GROUP BY 1, 2)
    SELECT a, b, round(coalesce(dot/sqrt(qa*qb), 0), 6) AS cos, round(coalesce(dot/(qa+qb-dot), 0), 6) AS jac, round(coalesce(l/(sa+sb-l), 0), 6) AS mins, round(coalesce(l/sa, 0), 6) AS amin FROM p LEFT JOIN m USING (a, b)"""))
def txt3_similarity(spark: SparkSession, d: str) -> DataFrame:
    m = T.stored_once(T.coo(spark, d))
    ids = m.select("i").distinct()
    pairs = ids.select(F.col("i").alias("a"), (F.col("i") + 1).alias("b")).join(ids.select(F.col("i").alias("b")), "b", "left_semi").select("a", "b")
    out = pairs
    for name, kind in (("cos", "COS"), ("jac", "JAC"), ("mins", "MIN"), ("amin", "AMIN")):
        out = out.join(S.similarity(m, pairs, kind).select("a", "b", F.round("sim", 6).alias(name)), ["a", "b"])
    return out


@query(sql(f"""WITH {UNIT}, s AS (SELECT a.i AS q, b.i, round(sum(a.v*b.v), 9) AS sim FROM u a JOIN u b ON a.j = b.j AND a.i <> b.i AND a.i % 10 = 0 GROUP BY 1, 2 HAVING round(sum(a.v*b.v), 9) >= 0.05)
    SELECT q, i, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, i) AS rank FROM s) WHERE rank <= 10"""))
def txt4_similar_rows(spark: SparkSession, d: str) -> DataFrame:
    u = S.normalised(T.coo(spark, d), 2)
    q = u.filter("i % 10 = 0").select(F.col("i").alias("q"), "j", "v")
    return S.similar_rows(u, q, 0.05, 10).select("q", "i", r6(F.col("sim")).alias("sim"), "rank")


@query(sql("SELECT i, term, v FROM docterm"))
def txt5_doc_term(spark: SparkSession, d: str) -> DataFrame:
    from latticework.functions.strings import tokens

    words = tokens(F.lower("text"), " .,\n")
    t = T.read(spark, d, "documents").select(F.col("doc_id").alias("i"), F.explode(words).alias("term")).filter(F.length("term") >= 3)
    return t.groupBy("i", "term").agg(F.count("*").cast("double").alias("v"))


@query(sql("WITH o AS (SELECT i, j, v, coalesce(sum(v) OVER (PARTITION BY i ORDER BY v DESC, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(v) OVER (PARTITION BY i) AS t FROM coo) SELECT i, j, v FROM o WHERE b <= 0.8*t"))
def win2_low_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.low_filter(T.coo(spark, d), 1, 0.8)


@query(sql("SELECT i, j, v FROM coo QUALIFY row_number() OVER (PARTITION BY i ORDER BY v DESC, j) <= 3 OR v >= 60"))
def win3_topk_plus(spark: SparkSession, d: str) -> DataFrame:
    return S.topk_plus(T.coo(spark, d), 3, 60.0)


@query(sql("SELECT i, j, v FROM coo QUALIFY v > 900.0 / count(*) OVER (PARTITION BY i)"))
def win4_zscore_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.zscore_filter(T.coo(spark, d), 900.0)


@query(sql("WITH n AS (SELECT j, row_number() OVER (ORDER BY count(*) DESC, j) - 1 AS k FROM coo GROUP BY j) SELECT i, k AS j, v FROM coo JOIN n USING (j)"))
def win5_compact_columns(spark: SparkSession, d: str) -> DataFrame:
    return S.compacted(T.coo(spark, d))


@query(sql("SELECT i, string_agg(j || ':' || CAST(CAST(v AS INTEGER) AS VARCHAR), ' ' ORDER BY j) AS line FROM coo GROUP BY i"))
def srt5_sorted_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = T.coo(spark, d).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("e"))
    return rows.select("i", F.array_join(F.transform("e", lambda e: F.concat(e["j"].cast("string"), F.lit(":"), e["v"].cast("int").cast("string"))), " ").alias("line"))


def _itemset_sql(least: int, longest: int) -> str:
    """Common table expressions l1, l2, ... of the frequent sets of each length."""
    out = [f"l1 AS (SELECT item AS i1, count(*) AS support FROM tx GROUP BY item HAVING count(*) >= {least})", "t AS (SELECT tid, item FROM tx SEMI JOIN l1 ON item = i1)"]
    for k in range(2, longest + 1):
        names = [f"i{m}" for m in range(1, k + 1)]
        joins = " ".join(f"JOIN t t{m} ON t1.tid = t{m}.tid AND t{m - 1}.item < t{m}.item" for m in range(2, k + 1))
        known = f"SEMI JOIN l{k - 1} p ON " + " AND ".join(f"t{m}.item = p.i{m}" for m in range(1, k)) if k > 2 else ""
        out.append(f"l{k} AS (SELECT {', '.join(f't{m}.item AS {n}' for m, n in enumerate(names, 1))}, count(*) AS support FROM t t1 {joins} {known} GROUP BY ALL HAVING count(*) >= {least})")
    return "WITH " + ", ".join(out)


def _set_rows(k: int) -> str:
    return f"SELECT {" || '+' || ".join(f'i{m}' for m in range(1, k + 1))} AS items, support FROM l{k}"


@query(sql(f"{_itemset_sql(20, 3)} {_set_rows(1)} UNION ALL {_set_rows(2)} UNION ALL {_set_rows(3)}"))
def min1_frequent_itemsets(spark: SparkSession, d: str) -> DataFrame:
    return I.itemsets(T.tx(spark, d), 20, longest=3).sets.select(F.array_join("items", "+").alias("items"), "support")


@query(sql(f"{_itemset_sql(4, 4)} {_set_rows(2)} UNION ALL {_set_rows(3)} UNION ALL {_set_rows(4)}"))
def min1_longer_itemsets(spark: SparkSession, d: str) -> DataFrame:
    """Sets of two to four items."""
    return I.itemsets(T.tx(spark, d), 4, longest=4, shortest=2).sets.select(F.array_join("items", "+").alias("items"), "support")


@query(sql(f"{_itemset_sql(6, 3)} SELECT i1 || '+' || i2 || '+' || i3 AS items, t1.tid AS tid FROM l3 JOIN t t1 ON t1.item = i1 JOIN t t2 ON t2.item = i2 AND t2.tid = t1.tid JOIN t t3 ON t3.item = i3 AND t3.tid = t1.tid"))
def min1_itemset_transactions(spark: SparkSession, d: str) -> DataFrame:
    """The transactions of each set of three items."""
    return I.itemsets(T.tx(spark, d), 6, longest=3, shortest=3).transactions().select(F.array_join("items", "+").alias("items"), "tid")
