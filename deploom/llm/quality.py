"""Quality classifier: a generalised additive model with pairwise interactions (Lou et al., 2013), boosted cyclically.

Each feature, and each of the strongest pairs of features, has a lookup table over bins. Rounds visit the tables in turn; a visit fits a
shallow tree to the residual of the log loss and adds its leaves to the table. A score is a sum of looked-up entries.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPREAD, slices, table, text_of

#: Labelled rows that the model is fitted on at most: a bounded sample, taken by hashes of doc_id.
MAX_FIT_ROWS = 20_000
THRESHOLD = 0.7

LOWER, UPPER, DIGITS = bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58))
SPACE = b" \t\n\r\x0b\x0c"
COMMON = b".,;:'\"()-?"
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in COMMON)

FEATURES = (
    "log_bytes", "lower", "upper", "digits", "marks", "common_marks", "space", "high_bytes", "bars", "bangs", "newlines", "word_length",
    "distinct_words", "distinct_pairs", "top_word", "distinct_lines", "capital_words", "marked_words", "long_words",
)


def features(text: str) -> list[float]:
    """Shares of kinds of bytes, words and lines in a whole text; an empty text has zeros."""
    data = text.encode("utf-8", "replace")
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    share = lambda chars: (n - len(data.translate(None, chars))) / n
    words = data.split()
    m = max(1, len(words))
    distinct = set(words)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1) if len(words) > 1 else 1.0
    counts: dict[bytes, int] = dict.fromkeys(distinct, 0)
    for w in words:
        counts[w] += 1
    lines = [x for x in data.split(b"\n") if x]
    capital = sum(map(bytes.isupper, words)) / m
    ends = bytes(w[-1] for w in words)
    marked = (len(ends) - len(ends.translate(None, MARKS))) / m
    long_words = sum(1 for w in words if len(w) > 24) / m
    return [
        float(np.log1p(n)), share(LOWER), share(UPPER), share(DIGITS), share(MARKS), share(COMMON), share(SPACE), 1 - len(data.decode("utf-8", "replace")) / n,
        data.count(b"|") / n, data.count(b"!") / n, data.count(b"\n") / m, n / m, len(distinct) / m, pairs,
        max(counts.values(), default=0) / m, len(set(lines)) / max(1, len(lines)), capital, marked, long_words,
    ]


@dataclass
class AdditiveModel:
    """Bins, lookup tables of single features, and tables of pairs over coarser bins; `base` is the log odds of label 1."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += values[np.searchsorted(edges, x[:, f], side="right")]
        bins = {f: np.searchsorted(self.coarse[f], x[:, f], side="right") for f in {f for p in self.pairs for f in p}}
        for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
            z += values[bins[a], bins[b]]
        return 1 / (1 + np.exp(-z))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))


def _leaves(grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float = 1.0) -> np.ndarray:
    """A shallow regression tree over ordered bins; the Newton step of each bin's leaf."""
    g, h = grad.sum(), hess.sum()
    if depth and len(grad) > 1:
        gl, hl = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
        k = int(np.argmax(gain))
        if gain[k] > 1e-9:
            return np.concatenate([_leaves(grad[: k + 1], hess[: k + 1], depth - 1, ridge), _leaves(grad[k + 1 :], hess[k + 1 :], depth - 1, ridge)])
    return np.full(len(grad), g / (h + ridge))


def _quadrants(grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best tree of one cut along each feature of a pair: its gain, and the step of each cell."""
    g, h = np.zeros((grad.shape[0] + 1, grad.shape[1] + 1)), np.zeros((grad.shape[0] + 1, grad.shape[1] + 1))
    g[1:, 1:], h[1:, 1:] = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    if min(grad.shape) < 2:
        return 0.0, np.zeros_like(grad)
    a, b = g[1:-1, 1:-1], h[1:-1, 1:-1]
    right, below = g[1:-1, -1:] - a, g[-1:, 1:-1] - a
    hr, hb = h[1:-1, -1:] - b, h[-1:, 1:-1] - b
    rest, hrest = g[-1, -1] - a - right - below, h[-1, -1] - b - hr - hb
    gain = a**2 / (b + ridge) + right**2 / (hr + ridge) + below**2 / (hb + ridge) + rest**2 / (hrest + ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(grad)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :] = a[i, j] / (b[i, j] + ridge), right[i, j] / (hr[i, j] + ridge)
    out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = below[i, j] / (hb[i, j] + ridge), rest[i, j] / (hrest[i, j] + ridge)
    return float(gain[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + ridge)), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 10, bins: int = 64, coarse: int = 8, rate: float = 0.1) -> AdditiveModel:
    """Boosts the tables of single features, then those of the n_pairs pairs that best explain the residual.

    No rows: every score is 0.5. Rows of one label only: a constant score near that label.
    """
    if not len(y):
        return AdditiveModel()
    model = AdditiveModel(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    if len(np.unique(y)) < 2:
        return model
    k = x.shape[1]
    model.edges = [_cuts(x[:, f], bins) for f in range(k)]
    model.coarse = [_cuts(x[:, f], coarse) for f in range(k)]
    at = [np.searchsorted(model.edges[f], x[:, f], side="right") for f in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        for f in range(k):
            p = 1 / (1 + np.exp(-z))
            size = len(model.tables[f])
            step = rate * _leaves(np.bincount(at[f], y - p, size), np.bincount(at[f], p * (1 - p), size), 2)
            model.tables[f] += step
            z += step[at[f]]
    rough = [np.searchsorted(model.coarse[f], x[:, f], side="right") for f in range(k)]

    def cells(a: int, b: int):
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        cell = rough[a] * shape[1] + rough[b]
        p = 1 / (1 + np.exp(-z))
        return cell, np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    ranked = sorted(itertools.combinations(range(k), 2), key=lambda p: -_quadrants(*cells(*p)[1:])[0])
    model.pairs = ranked[:n_pairs]
    model.pair_tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for i, pair in enumerate(model.pairs):
            cell, grad, hess = cells(*pair)
            step = rate * _quadrants(grad, hess)[1]
            model.pair_tables[i] += step
            z += step.ravel()[cell]
    return model


def held_out(doc_id):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> AdditiveModel:
    """Fits on at most max_rows labelled rows, held-out ids excluded. Labels that are null, or whose doc_id is null or absent, teach nothing. Of rows that
    repeat an id, that of the least text teaches, so that an id counts once for each label however many rows have it."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    share = min(1.0, 0.9 * max_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)) < int(share * SPREAD)).limit(max_rows)

    def run(batches):
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    chosen = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(known), "doc_id")
    chosen = chosen.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("text", "quality")
    rows = chosen.mapInArrow(run, "y int, x array<double>").toArrow()
    x = np.array(rows.column("x").combine_chunks().flatten(), float).reshape(-1, len(FEATURES))
    y = rows.column("y").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # the model doesn't depend on the order of rows
    return fit(x[order], y[order])


def score_rows(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row; a null text scores as an empty one."""

    def run(batches):
        for batch in slices(batches):
            x = np.array([features(t.as_py()) for t in batch.column(1)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])

    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score is at least threshold, columns as they are. Without labels of both kinds nothing is known and nothing is dropped."""
    model = learn(docs, labels)
    if not model.tables:
        return docs

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            x = np.array([features("" if t is None else t) for t in texts], float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_rows(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
