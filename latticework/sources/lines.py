"""Plain text as ordered lines: any number of files of any size, none of them in one row or one task.

A document is a file, or a folder whose files follow each other by name; small documents may share files as bundles, each line after its document's name
and a tab, a document's lines one after another. Spark reads its lines in blocks; a line's place is its block and its place
there. What needs an order (numbers, what a header said) works within blocks and carries one row for each block on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.sources.scratch import stored

PLACE = ["doc", "file", "block", "at"]
#: Lines and characters of a task that sorts or writes lines.
TASK_LINES, TASK_CHARS = 400_000, 32_000_000
#: Lines that are summed or looked through together: two to this power, of one block.
PIECE_BITS = 16


def line_tasks(lines: DataFrame) -> int:
    """Tasks for a stored table with lines, so that none of them holds more as the table grows."""
    n, chars = lines.agg(F.count("*"), F.coalesce(F.sum(F.length("line")), F.lit(0))).first()
    return max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_LINES), -(-chars // TASK_CHARS))


def lines_of(spark: SparkSession, path: str, folders: bool = False, comment: str | None = None, bundles: bool = False) -> DataFrame:
    """A stored table (doc, file, block, at, line) of the lines below path, of which folders or bundles may be documents.

    comment is a pattern of what is left out of a line before anything else; lines that are blank then stay out as well.
    """
    file = F.col("_metadata.file_path")
    raw = spark.read.text(path).select(file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    doc = F.expr("substring(file, 1, length(file) - length(substring_index(file, '/', -1)) - 1)") if folders else F.col("file")
    if bundles:
        raw, doc = raw.select("file", "block", F.substring_index("line", "\t", 1).alias("name"), F.expr("substring(line, instr(line, '\\t') + 1)").alias("line")), F.col("name")
    line = F.regexp_replace("line", comment, "") if comment else F.col("line")
    rows = raw.select(doc.alias("doc"), "file", "block", line.alias("line"))
    kept = rows.filter(F.trim("line") != "") if comment else rows
    # Places are given last, so that those of a block have no gaps.
    return stored(kept.select("doc", "file", "block", F.monotonically_increasing_id().alias("at"), "line"), "lines")


def numbered(lines: DataFrame, name: str = "n", weight: Column | None = None) -> DataFrame:
    """lines with the number of lines of their document before them, or the sum of weight over those.

    Without a weight these are all the lines that lines_of gives: a reader that leaves some out gives them no weight, and drops them afterwards.
    """
    before = lambda by: W.partitionBy("doc").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    if weight is None:
        blocks = lines.groupBy("doc", "file", "block").agg(F.count("*").alias("held"), F.min("at").alias("start"))
        ahead = blocks.select("doc", "file", "block", (F.coalesce(F.sum("held").over(before(["file", "block"])), F.lit(0)) - F.col("start")).alias("ahead"))
        return lines.join(stored(ahead, "ahead"), ["doc", "file", "block"]).withColumn(name, F.col("ahead") + F.col("at")).select(*lines.columns, name)
    piece = ["doc", "file", "block", "piece"]
    weighed = lines.withColumns({"piece": F.shiftright("at", PIECE_BITS), "weight": weight.cast("long")})
    ahead = weighed.groupBy(*piece).agg(F.sum("weight").alias("held")).select(*piece, F.coalesce(F.sum("held").over(before(["file", "block", "piece"])), F.lit(0)).alias("ahead"))
    within = F.sum("weight").over(W.partitionBy(*piece).orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    placed = weighed.repartition(line_tasks(lines), *piece).withColumn("within", F.coalesce(within, F.lit(0)))
    return stored(placed.join(stored(ahead, "ahead"), piece).withColumn(name, F.col("ahead") + F.col("within")).select(*lines.columns, name), "numbered")


def told(lines: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """lines with, under each name, what their document says there; no more than one line of a document may have that mark."""
    says = lines.withColumns({f"mark_{k}": c for k, c in marks.items()}).filter(" or ".join(f"mark_{k} is not null" for k in marks))
    return lines.join(stored(says.groupBy("doc").agg(*[F.max(f"mark_{k}").alias(k) for k in marks]), "told"), "doc", "left")


def carried(lines: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """lines with, under each name, the last value of that mark that is no null, on this line or any before it in its document."""
    piece = ["doc", "file", "block", "piece"]
    marked = lines.withColumns({"piece": F.shiftright("at", PIECE_BITS)} | {f"mark_{k}": c for k, c in marks.items()})
    ends = marked.groupBy(*piece).agg(*[F.max_by(f"mark_{k}", F.when(F.col(f"mark_{k}").isNotNull(), F.col("at"))).alias(f"end_{k}") for k in marks])
    before = W.partitionBy("doc").orderBy("file", "block", "piece").rowsBetween(W.unboundedPreceding, -1)
    ends = stored(ends.select(*piece, *[F.last(f"end_{k}", True).over(before).alias(f"from_{k}") for k in marks]), "ends")
    within = W.partitionBy(*piece).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    seen = marked.repartition(line_tasks(lines), *piece).withColumns({f"last_{k}": F.last(f"mark_{k}", True).over(within) for k in marks}).join(ends, piece)
    return seen.select(*lines.columns, *[F.coalesce(f"last_{k}", f"from_{k}").alias(k) for k in marks])


def write_lines(lines: DataFrame, path: str, order: list[str], key: str = "key", bundles: bool = False) -> None:
    """lines (key, line and the columns of order) as text below path, in order: a folder key=... for each key, of as many files as its rows need.

    Rows are dealt by ranges of key and order, so one key may have any part of them. Where keys are many, each with few lines, bundles keep files from being
    as many as keys; a key's text has no tab or line break then, and no key is an empty name.
    """
    held = stored(lines.select(key, *order, "line"), "written")
    dealt = held.repartitionByRange(line_tasks(held), key, *order).sortWithinPartitions(key, *order)
    if bundles:
        name = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\t"))
        dealt.select(F.concat(name, F.replace("line", F.lit("\n"), F.concat(F.lit("\n"), name))).alias("value")).write.text(path)
    else:
        dealt.select(key, F.col("line").alias("value")).write.partitionBy(key).text(path)
