"""Vectors in packed blocks, scores as exact whole numbers, and a set of queries that meets every block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, number_of, partitions

#: Rows of a block, and blocks that meet the queries in one group where the queries are too large to broadcast.
BLOCK_ROWS, GROUP_BLOCKS = 4096, 16
#: Query blocks whose results a task holds at once.
HELD = 64


def whole_rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """(id, v[, label]) of the rows that take part: no null id or label, no null vector, no null or non-finite component."""
    v = vectors[vec_col]
    kind = dict(vectors.dtypes)[vec_col]
    v = v if kind == "array<float>" else v.cast("array<double>")
    columns = [number_of(vectors, id_col).alias("id"), v.alias("v")] + ([number_of(vectors, label_col).alias("label")] if label_col else [])
    good = "id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return vectors.select(*columns).where(good + (" and label is not null" if label_col else ""))


def matrix(column, d: int) -> np.ndarray:
    """Rows of a list column as doubles, filled up with zeros or cut to d components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == d).all():
        return flat.reshape(-1, d)
    own = lengths.max(initial=0)
    out = np.zeros((len(lengths), max(d, own)))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out[:, :d]


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), scale being a power of two: doubles that hold whole numbers, or Python's integers where they could be too large."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 1 << 52:
        return y
    big = [int(a) if np.isfinite(a) else int(b) * scale for a, b in zip(y.ravel().tolist(), x.ravel().tolist(), strict=True)]
    out = np.empty(len(big), object)
    out[:] = big
    return out.reshape(x.shape)


def dots(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with a vector, or with the columns of a matrix, both made by whole()."""
    if not x.size:
        return np.zeros((len(x), *a.shape[1:]), np.int64)
    if x.dtype != object and a.dtype != object:
        bound = float(np.abs(x).max()) * float(np.abs(a).max()) * len(a)
        if bound < 1 << 53:
            return (x @ a).astype(np.int64)
        if bound < 1 << 62:
            return x.astype(np.int64) @ a.astype(np.int64)
    as_ints = lambda m: m if m.dtype == object else m.astype(np.int64).astype(object)
    return as_ints(x) @ as_ints(a)


def pack_blocks(df: DataFrame, tag: str, rows: int = BLOCK_ROWS, change: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """df in blocks of up to `rows` rows, one row (no, n, data) each, written; change adds columns to a block's rows first."""

    def run(batches):
        first, made = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table):
            nonlocal made
            t = change(t) if change else t
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(t.combine_chunks())
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([t.num_rows]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["no", "n", "data"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - sum(b.num_rows for b in held))
                held.append(part)
                at += part.num_rows
                if sum(b.num_rows for b in held) == rows:
                    yield flush(pa.Table.from_batches(held))
                    held = []
        if held:
            yield flush(pa.Table.from_batches(held))

    return materialize(df.mapInArrow(run, "no long, n long, data binary"), tag, codec="uncompressed")


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def meet(blocks: DataFrame, queries: DataFrame, work: Callable, out_schema: str, tag: str) -> DataFrame:
    """Every block of rows with every block of queries. work(state, queries_table, block_no, rows_table) -> state keeps what is best for the
    queries; state.rows() gives it as a record batch. The result holds that of each task, to be combined for each query.

    Queries of at most BROADCAST_BYTES go to every task. Beyond it, blocks are dealt over groups by salt and each group gets all queries once, so a
    task joins a bounded part of the rows with a stream of queries.
    """
    spark = blocks.sparkSession
    size = queries.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    n = partitions(spark)
    right = queries.select(F.col("no").alias("q_no"), F.col("data").alias("q_data"))
    if size <= BROADCAST_BYTES:
        one = F.lit(1)  # one group, by an expression of the row, so that this stays a hash join
        left = blocks.select("no", "data").repartition(n, "no").withColumn("salt", F.pmod("no", one))
        pairs = left.join(F.broadcast(right.withColumn("salt", F.pmod("q_no", one))), "salt")
    else:
        groups = max(n, -(-blocks.count() // GROUP_BLOCKS))
        left = blocks.select("no", "data", F.pmod(F.xxhash64("no"), F.lit(groups)).alias("salt"))
        right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        pairs = right.repartition(n, "salt").join(left.repartition(n, "salt"), "salt")

    def run(batches):
        states: dict[int, object] = {}
        tables: dict[int, pa.Table] = {}
        now, block = None, None
        for batch in batches:
            for q_no, q_data, no, data in zip(*(batch.column(k) for k in range(4)), strict=True):
                q_no, no = q_no.as_py(), no.as_py()
                if q_no not in tables:
                    if len(tables) >= HELD:
                        yield from (s.rows() for s in states.values())
                        states, tables = {}, {}
                    tables[q_no] = unpack(q_data.as_py())
                if no != now:
                    now, block = no, unpack(data.as_py())
                states[q_no] = work(states.get(q_no), tables[q_no], no, block)
        yield from (s.rows() for s in states.values())

    return materialize(pairs.select("q_no", "q_data", "no", "data").mapInArrow(run, out_schema), tag, batch_rows=4)


class Best:
    """The k best (score, id) of a query: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.items = k, []

    def floor(self):
        """The score that another row must reach; None while there is room."""
        return -self.items[-1][0] if len(self.items) == self.k else None

    def add(self, scores, ids) -> None:
        if len(scores) > 4 * self.k:
            order = np.lexsort((ids, [-s for s in scores] if scores.dtype == object else -scores))[: self.k]
            scores, ids = scores[order], ids[order]
        self.items = sorted([*self.items, *((-int(s), int(i)) for s, i in zip(scores.tolist(), ids.tolist(), strict=True))])[: self.k]


def first_rows(df: DataFrame, by: list[str], order: list, k: int, rank: str) -> DataFrame:
    """The first k rows of each group with their rank; Spark drops the others before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)
