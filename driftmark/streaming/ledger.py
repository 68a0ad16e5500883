"""Structured Streaming: outcomes arrive, a ledger of what is still pending is kept. IDs: SNK6 SRC12 D16, nearest equivalents of §2.13.

Each micro-batch is reduced to one row per path and merged into versioned Parquet folders in one directory.
A version is named by its batch id, so a batch that is repeated after a failure overwrites its own version
and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftmark.operators.reports import pending_ledger

SCHEMA = "path bigint, ref bigint"


def version_path(folder: str, batch_id: int) -> str:
    return f"{folder}/v{batch_id:012d}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def last_version(spark: SparkSession, folder: str) -> str:
    """The newest version that was written whole; an empty folder is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = [str(x.getPath()) for x in fs.listStatus(path) if x.getPath().getName().startswith("v") and _exists(spark, f"{x.getPath()}/_SUCCESS")]
    if not whole:
        raise FileNotFoundError(f"no ledger in {folder}")
    return max(whole)


def merge_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Merges one batch of ``path, ref, status, seq`` (latest seq of a path counts) into the ledger."""
    spark = batch.sparkSession
    before = version_path(folder, batch_id - 1)
    if batch_id > 0 and not _exists(spark, before):
        raise FileNotFoundError(f"the ledger of batch {batch_id - 1} is missing: {before}")
    old = spark.read.parquet(before) if batch_id > 0 else spark.createDataFrame([], SCHEMA)
    new = batch.groupBy("path").agg(F.max_by(F.struct("ref", "status"), "seq").alias("r")).select("path", "r.ref", "r.status")
    pending_ledger(old, new, ["path"], "ref").write.mode("overwrite").parquet(version_path(folder, batch_id))


def start_ledger(outcomes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream over all outcomes that are there, then stops; ``outcomes`` is a streaming DataFrame."""
    return outcomes.writeStream.foreachBatch(lambda b, i: merge_batch(b, i, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_outcomes(events: DataFrame, time_col: str, status_col: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Outcomes per time window and status, batch or streaming; with a watermark, so that state of closed windows is dropped."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), F.col(status_col).alias("status")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "status", "n")
