"""Shared pieces: reading tables, cutting lineage into shared storage, size-checked broadcasts, null-safe columns."""

from __future__ import annotations

import contextlib
import contextvars
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its rows times the bytes of a row stay under this; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20

#: Hashes are cut into so many parts to take a share of rows, which stays above none for any count of rows.
SPREAD = 1 << 50

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session, which must name one: a folder of the driver's own is not seen by executors elsewhere."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"{spark.sparkContext._jvm.java.lang.System.getProperty('java.io.tmpdir')}/deploom-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, tag: str, codec: str = "zstd", batch_rows: int | None = None) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it again, so that later stages need none of its lineage.

    Shuffle files of the write go when it ends, as nothing reads them again. batch_rows bounds the rows of its Arrow batches, for long texts.
    """
    path = f"{work_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    wanted = {CLEANUP: "true"} | ({BATCH: str(batch_rows)} if batch_rows else {})
    before = {k: conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    for folders in _open.get():
        folders.add(path)
    return out


#: Folders written inside each block of scratch() that is open in this thread.
_open: contextvars.ContextVar[tuple[set[str], ...]] = contextvars.ContextVar("open", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes the folders that materialize wrote inside the block when it ends, but for those taken out of the set that it gives."""
    folders: set[str] = set()
    token = _open.set((*_open.get(), folders))
    try:
        yield folders
    finally:
        _open.reset(token)
        discard(spark, *folders)


def written_apart(df: DataFrame, tag: str, by: str) -> tuple[str, dict]:
    """df written once with a folder for each value of a column, which is not in the files; (path, schema of the files)."""
    path = f"{work_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(by).parquet(path)
    return path, df.drop(by).schema


def discard(spark: SparkSession, *written: DataFrame | str) -> None:
    """Removes folders of the shared storage, or those of materialised tables, that nothing reads any more."""
    for x in written:
        folder = spark._jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else x.folder)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the bound; df must be cheap to count (a written table)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def number_of(df: DataFrame, column: str):
    """The column as a long; a column of another kind than whole numbers raises."""
    kind = dict(df.dtypes)[column]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{column} must hold whole numbers, not {kind}")
    return df[column].cast("long")


def text_of(df: DataFrame, column: str = "text"):
    """The text as a string that is never null."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    import zstandard

    head = np.array([len(arrays), *[len(a.tobytes()) for a in arrays]], "<i8").tobytes()
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 1)


def expand(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of a value made by squeeze, whose kinds are as named."""
    import zstandard

    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8)
    at, out = 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def slices(batches, rows: int = 512):
    """Arrow batches cut into pieces of a few rows, so that a task's Python objects are those of one piece."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
