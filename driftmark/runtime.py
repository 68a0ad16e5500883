"""What every operator needs from the session: tables, durable cuts of lineage, shipping of this package."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; Parquet, one file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage durably: ``checkpoint()`` into the folder that the cluster shares.

    The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset and the session is local, as in tests on one
    machine, a folder of this process is used; on a cluster, whose executors couldn't read that, it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors can read: ``spark.checkpoint.dir``; a temporary one in local sessions only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="driftmark-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers.

    Nothing happens where the workers inherit a PYTHONPATH that holds the package (the usual set-up).
    Otherwise a zip of the sources is added to the session once.
    """
    root = os.path.dirname(PACKAGE_DIR)
    held = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if os.path.realpath(root) in held or getattr(sc, "_driftmark_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="driftmark-ship-"), "driftmark_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(PACKAGE_DIR):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    sc._driftmark_shipped = True


def latest_by(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` value; ties go to the greatest remaining columns.

    A single aggregation with map-side combine (sorted by key, as strings are compared), so a hot key or many redeliveries of
    one record never gather in one task. Null ``order`` values lose against all others; null keys form a group.
    """
    best = F.max(F.struct(F.col(order).alias("__o"), *[F.col(c) for c in columns])).alias("__r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in columns])
