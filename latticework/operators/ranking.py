"""Ranked lists (list_id, score, label), wires, number streams and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.functions import geometry as G
from latticework.sources.scratch import stored

MODULUS, FACTOR = 2**31 - 1, 16807


def _cuts(ranked: DataFrame) -> DataFrame:
    """A row for each distinct score of a list, best first, with running counts; lists are summed up by score first."""
    g = ranked.groupBy("list_id", "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    w, all_of = W.partitionBy("list_id").orderBy(F.desc("score")), W.partitionBy("list_id")
    return g.select(
        "list_id", "p", "n", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"), F.sum("p").over(all_of).alias("pos"), F.sum("n").over(all_of).alias("neg")
    ).withColumns({"tp0": F.col("tp") - F.col("p"), "fp0": F.col("fp") - F.col("n")})


def roc_n(ranked: DataFrame, most_fp: int) -> DataFrame:
    """(list_id, roc): area under the curve up to most_fp false positives, as a share; equal scores make one sloping piece."""
    width = F.least(F.col("n"), F.greatest(F.lit(0), most_fp - F.col("fp0")))
    height = F.col("tp0") + F.try_divide(F.col("p") * width, F.col("n")) / 2
    return _cuts(ranked).groupBy("list_id").agg((F.sum(F.coalesce(width * height, F.lit(0.0))) / (F.max("pos") * most_fp)).alias("roc")).filter("roc is not null")


def best_accuracy(ranked: DataFrame) -> DataFrame:
    """(list_id, accuracy): the best share, in percent, of right answers over all cuts, that before the first row included."""
    c = _cuts(ranked)
    right = (F.col("tp") + F.col("neg") - F.col("fp")) * 100.0 / (F.col("pos") + F.col("neg"))
    return c.groupBy("list_id").agg(F.greatest(F.max(right), F.max(F.col("neg") * 100.0 / (F.col("pos") + F.col("neg")))).alias("accuracy"))


def median_rfp(ranked: DataFrame) -> DataFrame:
    """(list_id, rfp): share of negatives before half of the positives are reached, null without negatives; ties by doc_id."""
    w, all_of = W.partitionBy("list_id").orderBy(F.desc("score"), "doc_id"), W.partitionBy("list_id")
    r = ranked.select("list_id", F.sum("label").over(w).alias("tp"), F.sum(1 - F.col("label")).over(w).alias("fp"), F.sum("label").over(all_of).alias("pos"), F.sum(1 - F.col("label")).over(all_of).alias("neg"))
    return r.groupBy("list_id").agg(F.try_divide(F.min(F.when(F.col("tp") >= F.ceil(F.col("pos") / 2.0), F.col("fp"))), F.max("neg")).alias("rfp"))


def collapse_collinear(wires: DataFrame, tol: float, most_rounds: int = 200, fixed: DataFrame | None = None) -> DataFrame:
    """wires (wire, seq, x, y) without middle vertices within tol of their neighbours' chord; those that fixed (wire, seq) names stay.

    A round drops such vertices at every other place only, so that no two neighbours go at once, until none is left to drop.
    """
    held = F.lit(False)
    now = wires.select("wire", "seq", "x", "y", held.alias("held"))
    if fixed is not None:
        now = now.drop("held").join(fixed.select("wire", "seq").distinct().withColumn("held", F.lit(True)), ["wire", "seq"], "left").withColumn("held", F.coalesce("held", held))
    now, idle = stored(now, "wires"), 0
    for k in range(most_rounds):
        w = W.partitionBy("wire").orderBy("seq")
        near = G.closest_on_segment(G.point("px", "py"), G.point("nx", "ny"), G.point("x", "y"))
        m = now.select("*", *[F.lag(c).over(w).alias(f"p{c}") for c in "xy"], *[F.lead(c).over(w).alias(f"n{c}") for c in "xy"], (F.row_number().over(w) % 2).alias("turn"))
        drop = (F.col("turn") == k % 2) & ~F.col("held") & F.col("px").isNotNull() & F.col("nx").isNotNull() & (G.dist(near, G.point("x", "y")) <= tol)
        marked = stored(m.select("wire", "seq", "x", "y", "held", F.coalesce(drop, F.lit(False)).alias("drop")), "wires")
        idle = 0 if marked.filter("drop").limit(1).count() else idle + 1
        now = marked.filter("not drop").drop("drop")
        if idle == 2:
            return now.drop("held")
    raise RuntimeError("wires did not settle")


def lehmer(n: Column, seed: int, factor: int = FACTOR) -> Column:
    """State number n of the multiplicative generator, without the states before it: factor^n by squaring.

    The product of two numbers below 2^31 fits a long, so each step is exact.
    """
    powers, p = [], factor
    for _ in range(40):
        powers.append(p)
        p = p * p % MODULUS
    steps = F.array(*[F.struct(F.lit(1 << k).cast("long").alias("bit"), F.lit(v).cast("long").alias("by")) for k, v in enumerate(powers)])
    return F.aggregate(steps, F.lit(seed % MODULUS).cast("long"), lambda s, x: F.when(n.cast("long").bitwiseAND(x["bit"]) != 0, s * x["by"] % MODULUS).otherwise(s))


def luma(comps: Column, ch: Column) -> Column:
    """Brightness of 1 to 4 channels: weighted colours rounded one by one; alpha blends to white."""
    colour = F.floor(0.299 * ch[0] + 0.5) + F.floor(0.587 * ch[1] + 0.5) + F.floor(0.114 * ch[2] + 0.5)
    blend = lambda v, a: F.floor(v * a / 255.0 + 255 - a + 0.5)
    return F.when(comps == 1, ch[0]).when(comps == 2, blend(ch[0], ch[1])).when(comps == 3, colour).otherwise(blend(colour, ch[3])).cast("int")


def over(top: Column, below: Column) -> Column:
    """Four channels of top over below; where nothing covers, below stays."""
    ta, ba = top[3] / 255.0, below[3] / 255.0
    alpha = ta + ba * (1 - ta)
    # A little above one half, so that exact halves round up in spite of the division.
    mixed = [F.when(alpha == 0, below[k]).otherwise(F.floor((top[k] * ta + below[k] * ba * (1 - ta)) / alpha + 0.5 + 1e-9).cast("int")) for k in range(3)]
    return F.array(*mixed, F.floor(alpha * 255 + 0.5 + 1e-9).cast("int"))


#: Characters from dark to light.
RAMP = "@%#*+=-:. "


def ascii_rows(pixels: DataFrame, block: int) -> DataFrame:
    """(img, br, line): a character for the mean brightness of each block."""
    b = pixels.select("img", F.expr(f"r div {block}").cast("int").alias("br"), F.expr(f"c div {block}").cast("int").alias("bc"), luma(F.col("comps"), F.col("ch")).alias("l"))
    b = b.groupBy("img", "br", "bc").agg(F.expr("sum(l) div count(*)").alias("mean"))
    sign = F.substring(F.lit(RAMP), F.expr("cast(mean * 10 div 256 + 1 as int)"), F.lit(1))
    lines = b.groupBy("img", "br").agg(F.sort_array(F.collect_list(F.struct("bc", sign.alias("s")))).alias("row"))
    return lines.select("img", "br", F.array_join(F.transform("row", lambda e: e["s"]), "").alias("line"))
