"""Shared helpers: scratch tables in the shared folder and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows below which a side whose row width is bounded may be broadcast.
BROADCAST_ROWS = 20_000
#: The same for sides that are one long column: 8 MB of ids.
BROADCAST_IDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where it is unset on a local master."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return folder.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return sc.getCheckpointDir().rstrip("/")


#: Scratch paths of this process that are still there.
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release(spark: SparkSession, keep=()) -> None:
    """Delete the scratch data that this process made, but for `keep`: for a caller whose results are written."""
    for path in [p for p in _made if p not in keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove(path)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors.

    rows: how many go to Python at a time, at most, while it is written; the session's own bound is put back after.
    """
    path, conf, key = scratch_path(df.sparkSession, name), df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = conf.get(key)
    try:
        if rows and not 0 < int(held) <= rows:
            conf.set(key, rows)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if conf.get(key) != held:
            conf.set(key, held)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_checked(df: DataFrame, side: DataFrame, on, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a materialised side: broadcast if it has at most limit rows, else leave the strategy to the optimizer."""
    if side.limit(limit + 1).count() <= limit:
        side = F.broadcast(side)
    return df.join(side, on, how)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
