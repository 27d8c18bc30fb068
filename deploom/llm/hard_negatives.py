"""Hard-negative mining by product quantisation with stored residual norms.

Components are scaled to whole numbers. A vector is cut into SUBSPACES pieces; each is stored as the number of its nearest codeword and the
norm of what is left over. The score of a row with an anchor is the sum of looked-up products with codewords, plus or minus at most the sum over pieces of
the anchor's norm times the residual's norm. Rows that these bounds keep out of a window, or out of its first places, are left out for certain; the others
are scored in whole numbers, which decides. Codewords are fitted on a bounded sample; every row is indexed, and nothing is approximate in the result.

Two passes over the blocks: the first finds each anchor's positives, the second the rows of other labels in the window of each positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPREAD, discard, materialize, table
from .vector_blocks import Best, dots, first_rows, matrix, meet, pack_blocks, unpack, whole, whole_rows

#: Vectors that the codewords are fitted on at most, about.
MAX_FIT_VECTORS = 20_000
SUBSPACES, CODEWORDS, STEPS = 8, 128, 8
#: Anchors in a block, and those whose bounds are computed at once.
ANCHOR_ROWS, AT_ONCE = 1024, 128


class Codebook:
    """Codewords of each piece of the components; pieces are ranges of components."""

    def __init__(self, x: np.ndarray, d: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.d = d
        cuts = np.unique(np.linspace(0, d, min(subspaces, max(1, d)) + 1).astype(int))
        self.pieces = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        self.words = []
        for a, b in self.pieces:
            part = np.unique(x[:, a:b], axis=0) if len(x) else np.zeros((1, b - a))
            words = part[rng.permutation(len(part))[:codewords]]
            for _ in range(STEPS if len(part) > len(words) else 0):
                own = self.nearest(x[:, a:b], words)
                count = np.bincount(own, minlength=len(words))
                total = np.stack([np.bincount(own, x[:, c], len(words)) for c in range(a, b)], 1)
                words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words)
            self.words.append(words)

    @staticmethod
    def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        for a in range(0, len(x), 4096):
            out[a : a + 4096] = np.argmin((words * words).sum(1) - 2 * x[a : a + 4096] @ words.T, axis=1)
        return out

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, residual norms), (n, pieces) each."""
        codes = [self.nearest(x[:, a:b], w) for (a, b), w in zip(self.pieces, self.words, strict=True)]
        left = [np.sqrt(((x[:, a:b] - w[c]) ** 2).sum(1)) for (a, b), w, c in zip(self.pieces, self.words, codes, strict=True)]
        return np.stack(codes, 1).astype(np.uint8), np.stack(left, 1)

    def bounds(self, anchors: np.ndarray, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest scores of each anchor with each row; where they can't be computed they are NaN, which rules nothing out."""
        score, norms, scale = np.zeros((len(anchors), len(codes))), [], 0.0
        for m, ((a, b), w) in enumerate(zip(self.pieces, self.words, strict=True)):
            looked_up = anchors[:, a:b] @ w.T
            score += np.take(looked_up, codes[:, m], axis=1)
            norms.append(np.sqrt((anchors[:, a:b] ** 2).sum(1)))
            scale = scale + np.abs(looked_up).max(1)
        reach = np.stack(norms, 1) @ left.T
        reach += 1e-9 * (reach + np.asarray(scale)[:, None]) + 1e-6  # rounding of doubles
        return score - reach, score + reach


def fit_codebook(rows: DataFrame, scale: int, max_vectors: int = MAX_FIT_VECTORS) -> Codebook:
    total, d = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    share = max(1, int(min(1.0, max_vectors / max(1, total)) * SPREAD))
    sample = rows.where(F.pmod(F.xxhash64("v"), F.lit(SPREAD)) < share).select("v").limit(2 * max_vectors).toArrow().column("v")
    x = np.concatenate([np.floor(np.clip(matrix(c, d), -1e100, 1e100) * scale) for c in sample.chunks if len(c)] or [np.zeros((0, d))])
    return Codebook(x[np.lexsort(x.T[:8])] if len(x) and d else x, d)


class Rows:
    """A block of coded rows."""

    def __init__(self, t: pa.Table, scale: int, book: Codebook):
        self.ids, self.labels = t.column("id").to_numpy(), t.column("label").to_numpy()
        self.x = whole(matrix(t.column("v"), book.d), scale)
        self.codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.left = matrix(t.column("left"), len(book.pieces))


def kth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, -k)[-k]) if len(values) >= k else -np.inf


class Search:
    """Best rows of each window of each anchor of a block. Without windows there is one window of all rows of the anchor's label.

    A window is a range of scores, ends included.
    """

    def __init__(self, anchors: pa.Table, scale: int, book: Codebook, k: int, windows: bool):
        self.book, self.k = book, k
        self.no, self.ids, self.labels = (anchors.column(c).to_numpy() for c in ("ano", "id", "label"))
        self.x = whole(matrix(anchors.column("v"), book.d), scale)
        self.windows = anchors.column("windows").to_pylist() if windows else None
        self.best = [[Best(k) for _ in self.windows[i]] if windows else [Best(k)] for i in range(len(self.ids))]

    def see(self, rows: Rows) -> None:
        for a in range(0, len(self.ids), AT_ONCE):
            with np.errstate(all="ignore"):
                low, high = self.book.bounds(self.x[a : a + AT_ONCE].astype(np.float64), rows.codes, rows.left)
            for i in range(a, min(a + AT_ONCE, len(self.ids))):
                same = rows.labels == self.labels[i]
                ok = ~same if self.windows is not None else same
                at = np.flatnonzero(ok & (rows.ids != self.ids[i]))
                self.narrow(i, rows, at, low[i - a][at], high[i - a][at])

    def narrow(self, i: int, rows: Rows, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        if not len(at):
            return
        ranges = [(w["low"], w["high"]) for w in self.windows[i]] if self.windows is not None else [(-np.inf, np.inf)]
        wanted = np.zeros(len(at), bool)
        for best, (least, most) in zip(self.best[i], ranges, strict=True):
            # Rows that lie in the window for certain: k of them leave no place to a row whose greatest score is less than theirs.
            sure = low[(low >= least) & (high <= most)]
            floor = best.floor()
            need = max(kth_largest(sure, self.k), -np.inf if floor is None else float(floor) * (1 - 1e-12 if floor > 0 else 1 + 1e-12))
            wanted |= ~(high < max(need, least)) & ~(low > most)
        chosen = at[wanted]
        if not len(chosen):
            return
        scores, ids = dots(rows.x[chosen], self.x[i]), rows.ids[chosen]
        for best, (least, most) in zip(self.best[i], ranges, strict=True):
            floor = best.floor()
            inside = np.asarray((scores >= (least if floor is None else max(least, floor))) & (scores <= most), bool)
            if inside.any():
                best.add(scores[inside], ids[inside])

    def rows(self) -> pa.RecordBatch:
        out = [(n, w, -s, i) for n, found in zip(self.no.tolist(), self.best, strict=True) for w, b in enumerate(found) for s, i in b.items]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["ano", "window", "score", "found"])


def hard_negatives(
    vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank).

    anchors: a condition on `id` (a SQL expression). Components become floor(scale * x), scale being a power of two, and scores are inner products of these; a
    component that one of two vectors lacks counts as zero. A positive is one of the first rows of the anchor's label, a negative one of the first rows of another
    label whose score times 100 lies between least and most times the positive's; ties go to smaller ids. Rows with a null id, label, vector or component, or a
    component that isn't finite, take no part. Rows with the anchor's own id are neither positive nor negative. Repeated rows are rows, but an anchor that is
    repeated with all it has counts once. Ids and labels must be whole numbers. A score beyond 64 bits raises. Only the three columns are read.
    """
    rows = whole_rows(vectors, id_col, vec_col, label_col)
    book = fit_codebook(rows, scale)

    def coded(t: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            codes, left = book.encode(whole(matrix(t.column("v"), book.d), scale).astype(np.float64))
        codes = codes.reshape(t.num_rows, -1)
        return t.append_column("codes", pa.array([c.tobytes() for c in codes], pa.binary())).append_column("left", pa.array(list(left.reshape(t.num_rows, -1)), pa.list_(pa.float64())))

    blocks = pack_blocks(rows, "negatives-rows", change=coded)
    chosen = materialize(rows.where(anchors).distinct().withColumn("ano", F.monotonically_increasing_id()), "negatives-anchors")
    first = pack_blocks(chosen, "negatives-first", ANCHOR_ROWS)
    schema = "ano long, window int, score long, found long"
    best_first = [F.desc("score"), F.asc("found")]

    def searching(windows: bool, k: int):
        held: dict[int, Rows] = {}  # the block at hand, unpacked once for all query blocks that meet it

        def work(state, queries, no, block):
            if no not in held:
                held.clear()
                held[no] = Rows(block, scale, book)
            state = state or Search(queries, scale, book, k, windows)
            state.see(held[no])
            return state

        return work

    near = meet(blocks, first, searching(False, positives), schema, "negatives-near")
    near = materialize(first_rows(near, ["ano"], best_first, positives, "window").select("ano", (F.col("window") - 1).alias("window"), "score", "found"), "negatives-positives")
    # Ends of each window as whole numbers; that of a negative score is empty.
    wide = "cast(score as decimal(19,0))"
    ends = F.expr(
        f"named_struct('low', case when score > 0 then ({wide} * {least} + 99) div 100 else ({wide} * {least}) div 100 end,"
        f" 'high', case when score >= 0 then ({wide} * {most}) div 100 else -((99 - {wide} * {most}) div 100) end)"
    )
    windows = near.groupBy("ano").agg(F.transform(F.array_sort(F.collect_list(F.struct("window", ends.alias("w")))), lambda x: x["w"]).alias("windows"))
    second = pack_blocks(chosen.join(windows, "ano"), "negatives-second", ANCHOR_ROWS)
    far = meet(blocks, second, searching(True, negatives), schema, "negatives-far")
    far = first_rows(far, ["ano", "window"], best_first, negatives, "rank")
    out = far.join(near.select("ano", "window", F.col("score").alias("positive_score"), F.col("found").alias("positive_id")), ["ano", "window"]).join(chosen.select("ano", F.col("id").alias("anchor_id")), "ano")
    out = materialize(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), (F.col("window") + 1).cast("int").alias("positive_rank")), "negatives")
    discard(vectors.sparkSession, blocks, chosen, first, near, second)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    moved = v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, "id % 100 = 0")


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score FROM a JOIN v c ON a.vec_id <> c.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS positive_rank FROM s WHERE same QUALIFY positive_rank <= 5),
n AS (SELECT p.anchor_id, p.other AS positive_id, p.positive_rank, p.score AS positive_score, s.other AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score, positive_rank::INTEGER AS positive_rank FROM n
"""
