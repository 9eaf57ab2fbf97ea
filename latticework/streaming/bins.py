"""Streams: live counts of grid cells, and result steps as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.functions import geometry as G
from latticework.sources.scratch import shared_dir
from latticework.sources.textfiles import parse_steps


def counted(changes: DataFrame, size: float) -> DataFrame:
    """(bx, by, n) from change rows (x, y, delta), batch or stream; a cell goes when it is empty."""
    cells = changes.select(G.cell(F.col("x"), size).alias("bx"), G.cell(F.col("y"), size).alias("by"), "delta")
    return cells.groupBy("bx", "by").agg(F.sum("delta").alias("n"))


def live_bin_counts(spark: SparkSession, path: str, size: float) -> DataFrame:
    """Runs all change files below path through the streaming aggregation and returns the state that it leaves.

    Each trigger writes the cells that changed, with its number; a cell's count is that of its last trigger.
    """
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)
    out = f"{shared_dir(spark)}/bins-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, epoch: int) -> None:
        rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/state/epoch={epoch}")

    query = counted(stream, size).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    state = spark.read.parquet(f"{out}/state/epoch=*")
    return state.groupBy("bx", "by").agg(F.max_by("n", "epoch").alias("n")).filter("n > 0")


def arriving_steps(spark: SparkSession, path: str, out: str, files_a_batch: int = 8) -> DataFrame:
    """Reads step texts below path as they arrive, appends their rows to out, and reports (last, steps, missing).

    A batch that is run again overwrites what it wrote before.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    stream = files.option("maxFilesPerTrigger", files_a_batch).load(path).select(F.col("content").cast("string").alias("value"))

    def append(rows: DataFrame, epoch: int) -> None:
        parse_steps(rows.select("value")).write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    steps = spark.read.parquet(f"{out}/rows/epoch=*").select("step").distinct()
    gaps = steps.select("step", (F.col("step") - F.coalesce(F.lag("step").over(W.orderBy("step")), F.lit(0)) - 1).alias("gap"))
    return gaps.agg(F.max("step").alias("last"), F.count("*").alias("steps"), F.sum("gap").cast("long").alias("missing"))
