"""Queries of ranked lists, order, sets, strings and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.functions import strings as ST
from latticework.jobs.registry import query
from latticework.operators import ranking as R
from latticework.operators.graph import ranked
from latticework.sources import tables as T
from latticework.sources.tables import r6, sql

GROUPS = """g AS (SELECT list_id, score, sum(label) AS p, sum(1-label) AS n FROM ranked GROUP BY 1, 2),
    c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, coalesce(sum(p) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tp0, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fp0, sum(p) OVER (PARTITION BY list_id) AS pos, sum(n) OVER (PARTITION BY list_id) AS neg FROM g WINDOW w AS (PARTITION BY list_id ORDER BY score DESC))"""


@query(sql(f"WITH {GROUPS} SELECT list_id, round(sum(CASE WHEN fp <= 20 THEN (tp0+tp)/2.0*n WHEN fp0 < 20 THEN (tp0 + tp0 + p*(20-fp0)/n)/2.0*(20-fp0) ELSE 0 END) / (any_value(pos)*20), 6) AS roc FROM c GROUP BY list_id HAVING any_value(pos) > 0"))
def win6_roc_n(spark: SparkSession, d: str) -> DataFrame:
    return R.roc_n(T.ranked(spark, d), 20).select("list_id", r6(F.col("roc")).alias("roc"))


@query(sql(f"WITH {GROUPS} SELECT list_id, round(greatest(max((tp + neg - fp)*100.0/(pos+neg)), any_value(neg)*100.0/any_value(pos+neg)), 6) AS accuracy FROM c GROUP BY list_id"))
def win7_best_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return R.best_accuracy(T.ranked(spark, d)).select("list_id", r6(F.col("accuracy")).alias("accuracy"))


@query(sql("WITH r AS (SELECT *, sum(label) OVER w AS tp, sum(1-label) OVER w AS fp, sum(label) OVER (PARTITION BY list_id) AS pos, sum(1-label) OVER (PARTITION BY list_id) AS neg FROM ranked WINDOW w AS (PARTITION BY list_id ORDER BY score DESC, doc_id)) SELECT list_id, round(min(fp) FILTER (tp >= ceil(pos/2.0)) / nullif(any_value(neg), 0), 6) AS rfp FROM r GROUP BY list_id"))
def win8_median_rfp(spark: SparkSession, d: str) -> DataFrame:
    return R.median_rfp(T.ranked(spark, d)).select("list_id", r6(F.col("rfp")).alias("rfp"))


@query()
def win9_collapse_collinear(spark: SparkSession, d: str) -> DataFrame:
    """Each user's path by time without the vertices that lie near the line of their neighbours."""
    return R.collapse_collinear(T.points_ev(spark, d).select(F.col("user_id").alias("wire"), F.col("pid").alias("seq"), "x", "y"), 2.0).select("wire", "seq")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fifo, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS lifo, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS sorted FROM events")
def win10_container_order(spark: SparkSession, d: str) -> DataFrame:
    n = lambda *o: F.row_number().over(W.partitionBy("user_id").orderBy(*o)).cast("long")
    return T.read(spark, d, "events").select("event_id", n("ts", "event_id").alias("fifo"), n(F.desc("ts"), F.desc("event_id")).alias("lifo"), n("value", "event_id").alias("sorted"))


@query("SELECT event_id, row_number() OVER (ORDER BY value DESC, event_type, event_id) - 1 AS rank FROM events")
def srt1_sort(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").select("event_id", "value", "event_type")
    return ranked(e, [F.desc("value"), F.asc("event_type"), F.asc("event_id")]).select("event_id", "rank")


@query("SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 25")
def srt2_smallest(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "events").select("event_id", "value").orderBy("value", "event_id").limit(25)


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id DESC LIMIT 1")
def srt3_largest(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), F.desc("event_id")).limit(1)


@query("SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def srt4_topk_by_key(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return T.read(spark, d, "events").withColumn("rank", n).filter("rank <= 3").select("user_id", "event_id", "rank")


@query("SELECT event_id, row_number() OVER (ORDER BY md5(event_id || ':7'), event_id) - 1 AS rank FROM events")
def srt7_random_permutation(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").select("event_id")
    return ranked(e.withColumn("h", F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":7")))), [F.col("h"), F.col("event_id")]).select("event_id", "rank")


@query()
def rnd1_uniform(spark: SparkSession, d: str) -> DataFrame:
    """A draw of the 16807 generator for each event, its place in the stream being the event's number."""
    e = T.read(spark, d, "events").select(F.col("event_id").alias("n"))
    return e.select("n", R.lehmer(F.col("n") + 1, 12345).alias("state")).withColumn("u", F.col("state") / float(R.MODULUS))


@query()
def rnd2_normal(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").select(F.col("event_id").alias("n"))
    pair = F.expr("n div 2") + 1
    u, v = R.lehmer(pair, 12345) / float(R.MODULUS), R.lehmer(pair, 54321) / float(R.MODULUS)
    return e.select("n", (10 + 2 * F.when(F.col("n") % 2 == 0, F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)).otherwise(F.sqrt(-2 * F.log(v)) * F.sin(2 * F.pi() * u))).alias("x"))


@query("SELECT l_partkey AS k FROM lineitem UNION ALL SELECT p_partkey FROM part")
def set1_merge(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).unionByName(T.read(spark, d, "part").select(F.col("p_partkey").alias("k")))


@query("SELECT k, side FROM (SELECT l_partkey AS k, 0 AS side FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT p_partkey, 1 FROM part) QUALIFY row_number() OVER (PARTITION BY k ORDER BY side) = 1")
def set2_merge_unique(spark: SparkSession, d: str) -> DataFrame:
    a = T.read(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("k"), F.lit(0).alias("side"))
    return a.unionByName(T.read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.lit(1).alias("side"))).groupBy("k").agg(F.min("side").alias("side"))


@query("SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def set3_difference(spark: SparkSession, d: str) -> DataFrame:
    gone = T.read(spark, d, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("k"))
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("k")).join(gone, "k", "left_anti")


@query("SELECT page_id, translate(url, 'abc/:', 'xyz') AS t FROM pages")
def str1_translate(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "pages").select("page_id", ST.translate(F.col("url"), "abc/:", "xyz").alias("t"))


@query("SELECT page_id, regexp_replace(url, '(t)(h)', '\\2\\1', 'g') AS t, CAST(1 + len(regexp_extract_all(url, 'th')) AS INTEGER) AS n, regexp_replace(url, '(?i)(E)(.)', '<\\2>') AS o FROM pages")
def str2_regex_replace(spark: SparkSession, d: str) -> DataFrame:
    p = T.read(spark, d, "pages").select("page_id", ST.substitute(F.col("url"), "(t)(h)", "$2$1").alias("s"), ST.substitute(F.col("url"), "(E)(.)", "<$2>", every=False, ignore_case=True).alias("o"))
    return p.select("page_id", F.col("s.text").alias("t"), F.col("s.matches").alias("n"), F.col("o.text").alias("o"))


@query("SELECT page_id, rtrim(url, '/0123456789') AS e, ltrim(url, 'htps:/') AS s FROM pages")
def str3_trim(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "pages").select("page_id", ST.trim_end(F.col("url"), "/0123456789").alias("e"), ST.trim_start(F.col("url"), "htps:/").alias("s"))


@query("SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, lower(p_type) = lower(upper(p_type)) AS eq FROM part")
def str4_case(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "part").select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_brand").alias("l"), ST.equal_ignoring_case(F.col("p_type"), F.upper("p_type")).alias("eq"))


@query("SELECT page_id, array_to_string(list_filter(string_split_regex(url, '[:/.?=&]+'), lambda t: t <> ''), ' ') AS t FROM pages")
def str5_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "pages").select("page_id", F.array_join(ST.tokens(F.col("url"), ":/.?=&"), " ").alias("t"))


@query("SELECT page_id, row_number() OVER (ORDER BY reverse(url), page_id) - 1 AS rank FROM pages")
def str6_suffix_order(spark: SparkSession, d: str) -> DataFrame:
    p = T.read(spark, d, "pages").select("page_id", ST.suffix_key(F.col("url")).alias("k"))
    return ranked(p, [F.col("k"), F.col("page_id")]).select("page_id", "rank")


@query("SELECT event_id, strftime(ts, '%m/%d/%Y %H:%M:%S') AS t, CAST(floor(epoch(ts)) AS BIGINT) AS back FROM events")
def str7_time(spark: SparkSession, d: str) -> DataFrame:
    t = ST.from_time(F.col("ts"))
    return T.read(spark, d, "events").select("event_id", t.alias("t"), F.unix_seconds(ST.to_time(t).cast("timestamp")).alias("back"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE -1 END AS id FROM events")
def str8_name_id(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "events").select("event_id", ST.id_of(F.col("event_type"), {"view": 0, "click": 1}).alias("id"))


LUMA = "CASE comps WHEN 1 THEN ch[1] WHEN 2 THEN CAST(floor(ch[1]*ch[2]/255.0 + 255 - ch[2] + 0.5) AS INTEGER) WHEN 3 THEN l ELSE CAST(floor(l*ch[4]/255.0 + 255 - ch[4] + 0.5) AS INTEGER) END"
LUM = f"lum AS (SELECT img, r, c, {LUMA} AS luma FROM (SELECT *, CAST(floor(0.299::DOUBLE*ch[1]+0.5) + floor(0.587::DOUBLE*ch[2]+0.5) + floor(0.114::DOUBLE*ch[3]+0.5) AS INTEGER) AS l FROM pixels))"


@query(sql(f"WITH {LUM} SELECT img, r, c, luma FROM lum"))
def img1_luma(spark: SparkSession, d: str) -> DataFrame:
    return T.pixels(spark, d).select("img", "r", "c", R.luma(F.col("comps"), F.col("ch")).alias("luma"))


@query(sql("""WITH z AS (SELECT a.img, a.r, a.c, a.ch AS t, b.ch AS u FROM pixels a JOIN pixels b ON b.img = a.img AND b.r = a.r AND b.c = 63 - a.c), o AS (SELECT *, t[4]/255.0 + u[4]/255.0*(1-t[4]/255.0) AS oa FROM z)
    SELECT img, r, c, CASE WHEN oa = 0 THEN u[1] ELSE CAST(floor((t[1]*(t[4]/255.0) + u[1]*(u[4]/255.0)*(1-t[4]/255.0))/oa + 0.5 + 1e-9) AS INTEGER) END AS red, CAST(floor(oa*255 + 0.5 + 1e-9) AS INTEGER) AS alpha FROM o"""))
def img2_blend(spark: SparkSession, d: str) -> DataFrame:
    p = T.pixels(spark, d)
    below = p.select("img", "r", (63 - F.col("c")).alias("c"), F.col("ch").alias("u"))
    both = p.join(below, ["img", "r", "c"]).select("img", "r", "c", R.over(F.col("ch"), F.col("u")).alias("o"))
    return both.select("img", "r", "c", F.col("o")[0].alias("red"), F.col("o")[3].alias("alpha"))


@query(sql(f"""WITH {LUM}, b AS (SELECT img, r // 4 AS br, c // 4 AS bc, CAST(sum(luma) // count(*) AS INTEGER) AS mean FROM lum GROUP BY 1, 2, 3)
    SELECT img, br, string_agg(substr('@%#*+=-:. ', mean * 10 // 256 + 1, 1), '' ORDER BY bc) AS line FROM b GROUP BY img, br"""))
def img3_ascii(spark: SparkSession, d: str) -> DataFrame:
    return R.ascii_rows(T.pixels(spark, d), 4)


@query(sql("SELECT img, r // 8 AS r, c // 8 AS c, round(avg(ch[1]), 6) AS red FROM pixels GROUP BY img, r // 8, c // 8"))
def img4_downscale(spark: SparkSession, d: str) -> DataFrame:
    p = T.pixels(spark, d)
    return p.groupBy("img", F.expr("r div 8").cast("int").alias("r"), F.expr("c div 8").cast("int").alias("c")).agg(r6(F.avg(F.col("ch")[0])).alias("red"))


@query(sql("SELECT img, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, coalesce(ch[1], 255) AS red FROM (SELECT * FROM (SELECT DISTINCT img FROM pixels), range(64) a(r), range(64) b(c)) LEFT JOIN pixels USING (img, r, c)"))
def img5_white_canvas(spark: SparkSession, d: str) -> DataFrame:
    # Each image's whole canvas: its pixels over white.
    p = T.pixels(spark, d)
    side = F.sequence(F.lit(0), F.lit(63))
    canvas = p.select("img").distinct().select("img", F.explode(side).alias("r")).select("img", "r", F.explode(side).alias("c"))
    return canvas.join(p, ["img", "r", "c"], "left").select("img", "r", "c", F.coalesce(F.col("ch")[0], F.lit(255)).alias("red"))
