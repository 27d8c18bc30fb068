"""Exact top-k by inner product with M-trees (Ciaccia, Patella and Zezula, 1997) and best-first search.

Vectors become whole numbers. With one more component that brings every vector to the same norm R, the inner product of a query q (that component zero) and a
vector x is (|q|^2 + R^2 - d(q, x)^2) / 2, so that the best scores are the nearest neighbours in a metric. The component is never stored: distances come from
inner products and norms.

Rows are dealt by their nearest of a few sampled vectors, in groups of about TREE_ROWS, and each group is a tree. A page holds up to PAGE entries. An
entry of an inner page is a routing vector with its covering radius and the distance to the routing vector of its page; an entry of a leaf is a row with
that distance. Search takes pages in order of the least distance they can hold, and passes over entries by |d(q, parent) - d(parent, entry)| before any
product is computed. It ends when no page can hold a row that ranks among the k best; these are carried from tree to tree of a task. The queries of a block
search a tree together, so that a page read by many of them is one product of matrices. Rows are ranked by exact whole numbers; distances only rule out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPREAD, discard, materialize, partitions, small, table
from .vector_blocks import Best, dots, first_rows, matrix, meet, pack_blocks, whole, whole_rows

PAGE = 64
#: Rows of a tree, about; sampled vectors that rows are dealt by, and rows that these are taken from, at most.
TREE_ROWS, CENTRES, SAMPLE = 8192, 64, 20_000
QUERY_ROWS = 1024
#: Distances are off by at most this share of the norms; nothing is ruled out by less.
SLACK = 1e-6


class Tree:
    """Pages over the rows of x, whole numbers. Nodes are arrays; the children of an inner node, and the rows of a leaf, lie side by side.

    row: the routing vector; radius: it covers all below; up: its distance to the routing vector of the page it is an entry of; first, count: entries; leaf.
    order: rows of x in the order of leaves; entry_up: their distances to the leaf's routing vector.
    """

    FIELDS = ("row", "radius", "up", "first", "count", "leaf")

    def __init__(self, x: np.ndarray, ids: np.ndarray, seed: int = 3):
        self.x, self.ids = x, ids
        y = x.astype(np.float64)
        self.norm2 = (y * y).sum(1)
        self.top2 = float(self.norm2.max(initial=0))
        self.lift = np.sqrt(np.maximum(self.top2 - self.norm2, 0))
        rng = np.random.default_rng(seed)
        nodes: list[list] = []
        order: list[np.ndarray] = []
        entry_up: list[np.ndarray] = []

        def away(rows: np.ndarray, from_rows: np.ndarray) -> np.ndarray:
            product = y[rows] @ y[from_rows].T + self.lift[rows][:, None] * self.lift[from_rows]
            return np.sqrt(np.maximum(2 * (self.top2 - product), 0))

        def fill(node: int, rows: np.ndarray, dist: np.ndarray) -> None:
            """Entries below a node, whose routing vector is at `dist` from rows."""
            if len(rows) <= PAGE:
                nodes[node][3:] = [sum(len(o) for o in order), len(rows), True]
                order.append(rows)
                entry_up.append(dist)
                return
            routes = rows[rng.permutation(len(rows))[:PAGE]]
            d = away(rows, routes)
            own = np.argmin(d, axis=1)
            sizes = np.bincount(own, minlength=PAGE)
            if sizes.max() == len(rows):  # equal vectors: pages of rows as they come
                own = np.arange(len(rows)) * PAGE // len(rows)
                sizes = np.bincount(own, minlength=PAGE)
            parts = [(k, np.flatnonzero(own == k)) for k in np.flatnonzero(sizes)]
            first = len(nodes)
            nodes[node][3:] = [first, len(parts), False]
            up = away(routes, np.array([nodes[node][0]]))[:, 0]
            for k, at in parts:
                nodes.append([int(routes[k]), float(d[at, k].max()), float(up[k]), 0, 0, True])
            for n, (k, at) in enumerate(parts):
                fill(first + n, rows[at], d[at, k])

        root = 0
        everything = np.arange(len(x))
        dist = away(everything, np.array([root]))[:, 0]
        nodes.append([root, float(dist.max(initial=0)), 0.0, 0, 0, True])
        fill(0, everything, dist)
        for name, values in zip(self.FIELDS, zip(*nodes, strict=True), strict=True):
            setattr(self, name, np.array(values))
        self.order, self.entry_up = np.concatenate(order), np.concatenate(entry_up)

    def to_table(self, v: pa.ChunkedArray) -> pa.Table:
        """The tree as one table of rows in the order of leaves, with the nodes, which are fewer, beside the first ones."""
        pad = lambda a: pa.array(np.r_[a, np.zeros(len(self.order) - len(a), a.dtype)])
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        nodes = {"row": place[self.row]} | {f: getattr(self, f) for f in self.FIELDS[1:]}
        n = pa.array(np.full(len(self.order), len(self.row)))
        return pa.table({"id": pa.array(self.ids[self.order]), "v": v.take(pa.array(self.order)), "entry_up": pa.array(self.entry_up), "nodes": n} | {f: pad(a) for f, a in nodes.items()})

    @classmethod
    def of(cls, t: pa.Table, d: int, scale: int) -> Tree:
        out = cls.__new__(cls)
        out.x, out.ids = whole(matrix(t.column("v"), d), scale), t.column("id").to_numpy()
        y = out.x.astype(np.float64)
        out.floats = y
        out.norm2 = (y * y).sum(1)
        out.top2 = float(out.norm2.max(initial=0))
        n = t.column("nodes")[0].as_py()
        for f in cls.FIELDS:
            setattr(out, f, t.column(f).to_numpy()[:n])
        out.order, out.entry_up = np.arange(t.num_rows), t.column("entry_up").to_numpy()
        return out

    def pages(self, y: np.ndarray, far: np.ndarray, away) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, distance of the leaf's routing vector, least distance in it) of leaves that may hold a row within far of a query."""
        every = np.arange(len(y))
        out, todo = [], [(0, every, away(every, self.row[:1])[:, 0], np.zeros(len(y)))]
        while todo:
            node, own, d, least = todo.pop()
            least = np.maximum(least, d - self.radius[node])
            at = ~(least > far[own])
            own, d, least = own[at], d[at], least[at]
            if not len(own):
                continue
            if self.leaf[node]:
                out.append((own, np.full(len(own), node), d, least))
                continue
            kids = np.arange(self.first[node], self.first[node] + self.count[node])
            near = ~(np.abs(d[:, None] - self.up[kids]) - self.radius[kids] > far[own][:, None])
            kids, near = kids[near.any(axis=0)], near[:, near.any(axis=0)]
            to = away(own, self.row[kids])
            todo += [(int(k), own[m], to[m, j], least[m]) for j, (k, m) in enumerate(zip(kids, near.T, strict=True))]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))

    def search(self, x: np.ndarray, q_ids: np.ndarray, best: list[Best]) -> int:
        """Adds to the best of each query, a row of x, the rows that rank among them, but those of its own id; the number of products with rows.

        Every query reads its pages by falling nearness, a few in a round and twice as many in the next, and stops when the nearest one left is too far. The
        queries that read a page in one round are taken together.
        """
        y = x.astype(np.float64)
        q2 = (y * y).sum(1)
        slack = SLACK * (np.sqrt(q2) + np.sqrt(self.top2))
        far, floor = np.full(len(y), np.inf), np.full(len(y), -np.inf)
        done = 0

        def away(own, rows) -> np.ndarray:
            return np.sqrt(np.maximum(q2[own][:, None] + self.top2 - 2 * (y[own] @ self.floats[rows].T), 0))

        def limit(own) -> None:
            for i in own:
                score = best[i].floor()
                if score is not None:
                    floor[i] = float(score) - abs(float(score)) * 1e-12
                    far[i] = float(np.sqrt(max(q2[i] + self.top2 - 2 * float(score), 0.0))) + slack[i]

        limit(range(len(y)))
        own, leaf, dist, least = self.pages(y, far, away)
        order = np.lexsort((least, own))
        own, leaf, dist, least = own[order], leaf[order], dist[order], least[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        low, high = 0, 4
        while low <= place.max(initial=-1):
            now = np.flatnonzero((place >= low) & (place < high) & ~(least > far[own]))
            low, high = high, 2 * high
            if not len(now):
                break  # pages further on are no nearer
            now = now[np.argsort(leaf[now], kind="stable")]
            cuts = np.flatnonzero(np.r_[True, np.diff(leaf[now]) > 0, True])
            found = []
            for c, e in zip(cuts[:-1], cuts[1:], strict=True):
                qs, a = own[now[c:e]], int(self.first[leaf[now[c]]])
                b = a + int(self.count[leaf[now[c]]])
                near = ~(np.abs(dist[now[c:e]][:, None] - self.entry_up[a:b]) > far[qs][:, None])
                rows = np.flatnonzero(near.any(axis=0))
                if not len(rows):
                    continue
                done += len(rows) * len(qs)
                scores = dots(self.x[a:b][rows], x[qs].T)
                ids = self.ids[a:b][rows]
                r, q = np.nonzero(near[:, rows].T & (ids[:, None] != q_ids[qs]) & ~(scores.astype(np.float64) < floor[qs]))
                found.append((qs[q], scores[r, q], ids[r]))
            if found:
                qs, scores, ids = (np.concatenate(f) for f in zip(*found, strict=True))
                by = np.argsort(qs, kind="stable")
                qs, scores, ids = qs[by], scores[by], ids[by]
                cuts = np.flatnonzero(np.r_[True, np.diff(qs) > 0, True]) if len(qs) else [0]
                for c, e in zip(cuts[:-1], cuts[1:], strict=True):
                    best[qs[c]].add(scores[c:e], ids[c:e])
                limit(np.unique(qs).tolist())
        return done


class Top:
    """The best rows of each query of a block."""

    def __init__(self, queries: pa.Table, d: int, scale: int, k: int):
        self.no, self.ids = queries.column("qno").to_numpy(), queries.column("id").to_numpy()
        self.x = whole(matrix(queries.column("v"), d), scale)
        self.best = [Best(k) for _ in self.ids]

    def rows(self) -> pa.RecordBatch:
        out = [(n, -s, i) for n, b in zip(self.no.tolist(), self.best, strict=True) for s, i in b.items]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["qno", "score", "vec_id"])


def centres_of(rows: DataFrame, total: int, d: int) -> np.ndarray:
    """Sampled vectors, far from each other: each is the one farthest from those before it."""
    share = max(1, int(min(1.0, SAMPLE / max(1, total)) * SPREAD))
    sample = rows.where(F.pmod(F.xxhash64("v"), F.lit(SPREAD)) < share).select("v").limit(2 * SAMPLE).toArrow().column("v")
    x = np.concatenate([np.clip(matrix(c, d), -1e100, 1e100) for c in sample.chunks if len(c)] or [np.zeros((1, d))])
    x = x[np.lexsort(x.T[:8])] if d else x
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(CENTRES, -(-total // TREE_ROWS)) and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def plant_trees(rows: DataFrame, d: int, scale: int, total: int) -> DataFrame:
    """(no, n, data): one row for each tree over rows (id, v)."""
    spark = rows.sparkSession
    centres = centres_of(rows, total, d)

    def deal(batches):
        first, made = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            x = np.clip(matrix(batch.column(1), d), -1e100, 1e100)
            own = [np.argmin((centres * centres).sum(1) - 2 * x[a : a + 4096] @ centres.T, axis=1) for a in range(0, len(x), 4096)]
            no = np.arange(first + made, first + made + len(x))
            made += len(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *own]), pa.int32()), pa.array(no)], ["id", "v", "centre", "rowno"])

    dealt = materialize(rows.mapInArrow(deal, f"id long, v {dict(rows.dtypes)['v']}, centre int, rowno long"), "mtree-dealt")
    sizes = materialize(dealt.groupBy("centre").agg(F.ceil(F.count("*") / TREE_ROWS).alias("trees")), "mtree-sizes")
    placed = dealt.join(small(sizes, 16), "centre").withColumn("tree", F.pmod(F.xxhash64("rowno"), F.col("trees"))).select("centre", "tree", "id", "v")
    sorted_rows = placed.repartition(partitions(spark), "centre", "tree").sortWithinPartitions("centre", "tree", "id")

    def build(batches):
        first, made = TaskContext.get().partitionId() << 32, 0
        key, held = None, []

        def flush():
            nonlocal made
            t = pa.Table.from_batches(held)
            made += 1
            tree = Tree(whole(matrix(t.column("v"), d), scale), t.column("id").to_numpy()).to_table(t.column("v"))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, tree.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(tree.combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([t.num_rows]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["no", "n", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = batch.column(0).to_numpy().astype(np.int64) * (1 << 40) + batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1], True])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held and marks[a] != key:
                    yield flush()
                    held = []
                key = marks[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    trees = materialize(sorted_rows.mapInArrow(build, "no long, n long, data binary"), "mtree-trees", codec="uncompressed")
    discard(spark, dealt, sizes)
    return trees


def top_k(vectors: DataFrame, queries: str, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest score for each query, all if there are fewer; ties go to smaller ids.

    queries: a condition on `id` (a SQL expression). Components become floor(scale * x), scale being a power of two, and a score is the inner product of these; a
    component that one of two vectors lacks counts as zero. Rows with a null id, vector or component, or a component that isn't finite, take no part, nor
    do rows of the query's own id in its list. Repeated rows are rows, but a query that is repeated with its vector counts once. Ids must be whole numbers. A score
    beyond 64 bits raises. Only the two columns are read.
    """
    rows = whole_rows(vectors, id_col, vec_col)
    total, d = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    trees = plant_trees(rows, d, scale, total)
    chosen = materialize(rows.where(queries).distinct().withColumn("qno", F.monotonically_increasing_id()), "mtree-chosen")
    blocks = pack_blocks(chosen, "mtree-queries", QUERY_ROWS)
    held: dict[int, Tree] = {}

    def work(state, query_rows, no, t):
        if no not in held:
            held.clear()
            held[no] = Tree.of(t, d, scale)
        state = state or Top(query_rows, d, scale, k)
        held[no].search(state.x, state.ids, state.best)
        return state

    found = meet(trees, blocks, work, "qno long, score long, vec_id long", "mtree-found")
    best = first_rows(found, ["qno"], [F.desc("score"), F.asc("vec_id")], k, "rank")
    out = best.join(chosen.select("qno", F.col("id").alias("query_id")), "qno").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    out = materialize(out, "mtree-top")
    discard(vectors.sparkSession, trees, chosen, blocks, found)
    return out


def op13_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "id % 100 = 0")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""
