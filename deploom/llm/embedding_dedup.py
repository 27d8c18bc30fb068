"""Embedding near-dedup with iterative quantisation (Gong et al., 2013) and multi-index Hamming tables (Norouzi et al., 2012).

A rotation of the principal components is learned so that signs lose little; signs of rotated vectors are balanced binary codes. The code
is cut into substrings of up to 16 bits, each with a table of its own. Vectors of one label that agree in a substring are candidates, and their
cosine is taken from the original vectors in double precision. A pair found in several tables counts in the first.

One code of d bits gives d / 16 tables; further rotations from other starts give further tables. How many, and how wide a substring is, is
measured: pairs are made at the limit from vectors of the fitted sample, apart by differences of other vectors of it, and tables are added
until RECALL of these, and of the sample's own pairs near the limit, share a substring. Where MOST_TABLES are not enough (vectors with a large
common part, of which all are near each other), substrings become narrower. The tests measure recall against brute force.

Equal vectors of a label are one class with a count from the beginning. Buckets emit a count for each member and a forest of links, never
their pairs. A bucket over BLOCK members is cut into blocks, and each pair of blocks is a group of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPREAD, discard, materialize, small, table
from .components import components, local_components

#: Vectors that the rotations are fitted on at most, about: a bounded sample, taken by hash.
MAX_FIT_VECTORS = 20_000
TABLES, MOST_TABLES, WIDTHS = 16, 64, (16, 12, 8, 6, 4)
#: Share of the sample's pairs at the limit that tables must find; sampled vectors that pairs are made from or looked for among, at most.
RECALL, TRIALS = 0.97, 4000
#: Pairs of the sample near the limit that are looked at, at most.
NEAR_PAIRS = 20_000
BLOCK = 4096
RUN = 32


def fit_rotations(x: np.ndarray, steps: int = 20, seed: int = 11):
    """(mean, matrices): signs of (v - mean) @ matrix are a code. matrices gives one rotation of the principal components after the other."""
    d = x.shape[1]
    if not len(x):
        x = np.zeros((1, d))
    mean = x.mean(axis=0)
    centred = x - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    v = centred @ axes

    def matrices():
        rng = np.random.default_rng(seed)
        while True:
            r = np.linalg.qr(rng.standard_normal((d, d)))[0]
            for _ in range(steps):
                b = np.where(v @ r >= 0, 1.0, -1.0)
                left, _, right = np.linalg.svd(b.T @ v)
                r = (left @ right).T
            yield axes @ r

    return mean, matrices()


def codes(x: np.ndarray, mean: np.ndarray, matrix: np.ndarray, width: int) -> np.ndarray:
    """(n, tables) substrings of `width` bits, of vectors scaled to length 1."""
    if not width:
        return np.zeros((len(x), 1), np.uint16)
    bits = ((x - mean) @ matrix >= 0).reshape(len(x), -1, width)
    return (bits @ (1 << np.arange(width))).astype(np.uint16)


def pairs_at(x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of x and, for each, one at the limit from it, in the direction of a difference between two others; then pairs of x
    whose cosine is little above the limit."""
    n = min(len(x), TRIALS)
    rng = np.random.default_rng(5)
    a, y, z = (x[rng.integers(0, len(x), n)] for _ in range(3))
    away = y - z
    away -= (away * a).sum(axis=1, keepdims=True) * a
    size = np.sqrt((away * away).sum(axis=1))
    ok = size > 1e-9
    a, away = a[ok], away[ok] / size[ok, None]
    own = x[:TRIALS]
    close = own @ own.T
    i, j = np.nonzero(np.triu((close >= limit) & (close < limit + (1 - limit) / 4), 1))
    if len(i) > NEAR_PAIRS:
        chosen = rng.choice(len(i), NEAR_PAIRS, replace=False)
        i, j = i[chosen], j[chosen]
    return np.concatenate([a, own[i]]), np.concatenate([limit * a + np.sqrt(1 - limit * limit) * away, own[j]])


def fitted_tables(x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, matrix, width): as many tables, and substrings as wide, as find RECALL of pairs_at(x, limit). Width 0 is one table for all, by which
    every pair is compared once; it is taken where other tables would compare as many pairs."""
    d = x.shape[1]
    # Rotations suit the vectors that they were fitted on best, so others measure them.
    held = np.arange(len(x)) % 4 == 0
    a, b = pairs_at(x[held], limit) if len(x) and limit > -1 else (x[:0], x[:0])
    mean, more = fit_rotations(x[~held])
    columns = np.zeros((d, 0))
    for width in WIDTHS:
        tables = TABLES
        while tables <= MOST_TABLES:
            while columns.shape[1] < tables * width:
                columns = np.concatenate([columns, next(more)], axis=1)
            matrix = columns[:, : tables * width]
            if not len(a) or (codes(a, mean, matrix, width) == codes(b, mean, matrix, width)).any(axis=1).mean() >= RECALL:
                return (mean, matrix, width) if compared(x, mean, matrix, width) < 1 else (mean, matrix, 0)
            tables += 4
    return mean, matrix, 0


def compared(x: np.ndarray, mean: np.ndarray, matrix: np.ndarray, width: int) -> float:
    """How often the tables compare two vectors of the sample, on average: the share of all vectors that each one meets."""
    if len(x) < 2:
        return 0.0
    rng = np.random.default_rng(13)
    i, j = rng.integers(0, len(x), (2, TRIALS))
    own = codes(x, mean, matrix, width)
    return float((own[i] == own[j])[i != j].sum(axis=1).mean()) if (i != j).any() else 0.0


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def group_links(table_no: np.ndarray, group: np.ndarray, block: np.ndarray, own: np.ndarray, ids: np.ndarray, weight: np.ndarray, x: np.ndarray, code: np.ndarray, limit: float):
    """(id, links, root) of whole groups, rows sorted by group. Where block differs from own, only pairs across two blocks are compared.

    A row's `own` is the block it belongs to; `block` tells whether its group has one block (0) or two (1).
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    size_of = np.repeat(sizes, sizes)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        fresh = np.argmax(code[i] == code[j], axis=1) == table_no[i]  # not found in an earlier table
        fresh &= (block[i] == 0) | (own[i] != own[j])
        found.append((i[fresh], j[fresh]))

    at = np.flatnonzero((size_of > 1) & (size_of <= RUN))
    for step in range(1, RUN):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        near = np.einsum("ij,ij->i", x[at], x[at + step]) >= limit
        keep(at[near], at[near] + step)
    for k in np.flatnonzero(sizes > RUN):
        a, b = starts[k], starts[k] + sizes[k]
        for c in range(a, b, 256):
            i, j = np.nonzero(x[c : min(b, c + 256)] @ x[a:b].T >= limit)
            i, j = i + c, j + a
            keep(i[i < j], j[i < j])
    i, j = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
    links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    node, root = local_components(ids[i], ids[j])
    touched = np.flatnonzero(links)
    distinct, inverse = np.unique(ids[touched], return_inverse=True)
    total = np.bincount(inverse, links[touched], len(distinct)).astype(np.int64)
    return distinct, total, root[np.searchsorted(node, distinct)] if len(node) else distinct


def near_vectors(vectors: DataFrame, limit: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors.

    Rows link if their labels are equal and not null and their cosine is at least `limit`. Vectors that are null, empty or zero, or hold
    a null or non-finite component, link with nothing, nor do rows with a null label. Vectors of different length don't link. Repeated
    rows are rows: they link with each other. Null ids never name a component. Only the three columns are read.
    """
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].alias("v"), vectors[label_col].alias("label"))
    good = "label is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    usable = F.coalesce(F.expr(good), F.lit(False))
    classes = rows.where(usable).groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "itq-classes")
    total, d = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    share = max(1, int(min(1.0, MAX_FIT_VECTORS / max(1, total)) * SPREAD))
    sample = classes.where(F.pmod(F.xxhash64("v"), F.lit(SPREAD)) < share).select("v").limit(2 * MAX_FIT_VECTORS).toArrow().column("v")

    def padded(column) -> np.ndarray:
        lengths = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy().astype(np.float64)
        if (lengths == d).all():
            return flat.reshape(-1, d)
        out = np.zeros((len(lengths), d))
        out[np.arange(d) < lengths[:, None]] = flat
        return out

    fit_on = np.concatenate([padded(c) for c in sample.chunks if len(c)] or [np.zeros((0, d))])
    order = np.lexsort(fit_on.T[:8]) if len(fit_on) else []
    mean, matrix, width = fitted_tables(unit(fit_on[order]) if len(fit_on) else fit_on, limit)
    tables = matrix.shape[1] // width if width else 1

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                raw = batch.column(1)
                c = codes(unit(padded(raw)), mean, matrix, width)
                lengths = np.diff(raw.offsets.to_numpy()).astype(np.int64)
                keys = (lengths[:, None] << 32) | (np.arange(tables, dtype=np.int64) << 16) | c.astype(np.int64)
                offsets = pa.array(np.arange(0, keys.size + 1, tables), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], ["cid", "label", "keys"])

    label_type = dict(rows.dtypes)["label"]
    coded = materialize(classes.select("cid", "v", "label").mapInArrow(index, f"cid long, label {label_type}, keys array<long>"), "itq-codes")
    sizes = coded.select("label", F.explode("keys").alias("key")).groupBy("label", "key").count().where(f"count > {BLOCK}")
    large = materialize(sizes.select("label", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "itq-large")
    placed = coded.join(classes.select("cid", "v", "copies"), "cid").select("cid", "label", "v", "copies", "keys", F.explode("keys").alias("key"))
    placed = placed.join(small(large, 40), ["label", "key"], "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("cid"), "blocks"), F.lit(0)).cast("int"))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("other", F.explode(others))
    placed = placed.select("label", "key", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "cid", "copies", "keys", "v")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(n, "label", "key", "b1", "b2").sortWithinPartitions("label", "key", "b1", "b2")

    def compare(batches):
        held: pa.Table | None = None

        def run(t: pa.Table):
            t = t.combine_chunks()
            x = unit(padded(t.column("v").chunk(0) if t.num_rows else t.column("v").combine_chunks()))
            keys = t.column("keys").combine_chunks()
            code = keys.flatten().to_numpy().reshape(-1, tables)
            key = t.column("key").to_numpy()
            b1, b2 = t.column("b1").to_numpy(), t.column("b2").to_numpy()
            edge = edges_of(t)
            group_no = np.cumsum(edge) - 1
            ids, links, root = group_links((key >> 16) & 0xFFFF, group_no, (b1 != b2).astype(int), t.column("own").to_numpy(), t.column("cid").to_numpy(), t.column("copies").to_numpy().astype(float), x, code, limit)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(root)], ["cid", "links", "root"])

        def edges_of(t: pa.Table) -> np.ndarray:
            out = np.zeros(t.num_rows, bool)
            if t.num_rows:
                out[0] = True
                for name in ("label", "key", "b1", "b2"):
                    column = t.column(name).combine_chunks()
                    out[1:] |= np.asarray(pa.compute.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False), bool)
            return out

        import pyarrow.compute  # noqa: F401

        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            marks = np.flatnonzero(edges_of(held))
            whole = int(marks[-1]) if len(marks) else 0
            if whole:
                yield run(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield run(held)

    found = materialize(dealt.mapInArrow(compare, "cid long, links long, root long"), "itq-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links")).select(F.col("cid").alias("lc"), "links")
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    linked = classes.join(links, classes["cid"] == links["lc"], "left").join(roots, classes["cid"] == roots["node"], "left")
    linked = materialize(linked.select("cid", "label", "v", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")), "itq-linked")
    named = materialize(linked.groupBy("root").agg(F.min("first").alias("component_id")), "itq-named")
    by_class = materialize(linked.join(named, "root").select(F.col("label").alias("_l"), F.col("v").alias("_v"), "n_links", "component_id"), "itq-components")
    discard(vectors.sparkSession, classes, coded, large, found, linked, named)
    yes = rows.where(usable).join(by_class, (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v"))).select("id", "n_links", "component_id")
    no = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return yes.unionByName(no).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs of a label: the same rows where every pair at the limit is found.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, len(e) AS d, sqrt(list_dot_product(e, e)) AS size FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) >= 0.93 * a.size * b.size),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(least.component_id, v.vec_id) AS component_id, coalesce(least.component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON v.vec_id = n.a LEFT JOIN least ON v.vec_id = least.a
"""
