"""Cutting lineage into the folder that the session shares with its executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times the bytes of a row stay under this.
BROADCAST_BYTES = 16 << 20

#: Rows that a task of a wide step gets at most, if they are spread evenly.
TASK_ROWS = 500_000


def tasks(spark: SparkSession, rows: int) -> int:
    """The number of tasks among which rows are dealt: that of the session, or more, so that the memory of one stays as it is when tables grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"{spark.sparkContext._jvm.java.lang.System.getProperty('java.io.tmpdir')}/deploom-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder, and read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def folder_of(df: DataFrame) -> str:
    """The folder that written() made for a frame."""
    return df.folder


def remove(spark: SparkSession, *folders: str) -> None:
    """Removes folders of the shared storage that nothing reads any more."""
    for x in folders:
        folder = spark._jvm.org.apache.hadoop.fs.Path(x)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remove_written(*frames: DataFrame) -> None:
    """Removes what written() made of frames, or of the frames that they were put together from; nothing may read them any more."""
    for df in frames:
        remove(df.sparkSession, *({df.folder} if hasattr(df, "folder") else {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/step-" in f}))


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df with a broadcast hint if it is small; df must be a written table, as it is counted."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
