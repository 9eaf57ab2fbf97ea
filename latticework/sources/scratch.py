"""Tables that outlive an executor: written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go once the table that they were made for is written.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Only where a session names none and runs on one machine, as in tests, is a temporary folder set.
    """
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="latticework-"))
    return context.getCheckpointDir().get()


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, what: str = "table", batch_rows: int | None = None) -> DataFrame:
    """df written as a table in the shared folder and read from there: its lineage ends, and a lost executor costs nothing.

    batch_rows bounds the rows that go to Python at once meanwhile, for rows that are large.
    """
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    with _settings(df.sparkSession, CLEAN | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(table: DataFrame) -> None:
    """Deletes the files of a stored table that nothing will read any more."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if folder.startswith(shared_dir(spark)) or path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
