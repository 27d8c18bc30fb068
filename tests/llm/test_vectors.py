import collections
import math

import numpy as np
import pytest
from helpers import DATA

from deploom.llm import hard_negatives as hn
from deploom.llm import metric_tree as mt
from deploom.llm import vector_blocks as vb


def whole(v, scale):
    return [math.floor(int(x) * scale) if abs(x) >= 2**53 else math.floor(x * scale) for x in v]


def usable(data):
    return [(i, v, y) for i, v, y in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def plain_top(data, every, k=10, scale=1024):
    rows = [(i, whole(v, scale)) for i, v, _ in usable(data)]
    out = []
    for q in {(i, tuple(v)) for i, v in rows if i % every == 0}:
        ranked = sorted((-product(q[1], v), i) for i, v in rows if i != q[0])[:k]
        out += [(q[0], r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    return collections.Counter(out)


def plain_negatives(data, every, scale=256):
    rows = [(i, whole(v, scale), y) for i, v, y in usable(data) if y is not None]
    out = []
    for a, av, ay in {(i, tuple(v), y) for i, v, y in rows if i % every == 0}:
        scored = sorted((-product(av, v), i, y) for i, v, y in rows if i != a)
        for p, (ps, pi, _) in enumerate([s for s in scored if s[2] == ay][:5], 1):
            window = [(-s, i) for s, i, y in scored if y != ay and 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            out += [(a, pi, r, i, -ps, s, p) for r, (s, i) in enumerate(window, 1)]
    return collections.Counter(out)


def made(kind):
    """(id, vector, label): spread, clustered, equal and offset vectors, ties, repeats, nulls, other lengths, very large components."""
    rng = np.random.default_rng(len(kind))
    n = 700
    x = rng.standard_normal((n, 12))
    if kind == "clustered":
        x = rng.standard_normal((9, 12))[rng.integers(0, 9, n)] + x * 0.05
    if kind == "equal":
        x[50:] = x[0]
    if kind == "offset":
        x += 4
    if kind == "small":
        x = np.round(x * 2) / 512  # a few whole numbers: ties
    data = [(int(i), [float(np.float32(a)) for a in v], int(rng.integers(0, 3))) for i, v in zip(rng.permutation(n), x, strict=True)]
    data += [data[0], data[1], data[1], (0, [1.0] * 12, 1), (0, [1.0] * 12, 1), (None, [1.0] * 12, 1), (2000, None, 1), (2020, [1.0, None], 1), (2040, [float("nan")] * 12, 1), (2060, [0.5, 0.5], 2)]
    data += [(2080, [], 0), (2100, [0.0] * 12, 0), (2120, [1.0] * 12, None), (2140, [float("inf")] + [0.0] * 11, 0), (2160, [-1.0] * 14, 2)]
    return data


def frame(spark, data, kind="float"):
    return spark.createDataFrame([(*d, "x", 1) for d in data], f"vec_id long, embedding array<{kind}>, label int, id string, score int").repartition(5)


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal", "offset", "small"])
def test_both_searches_by_definition(spark, monkeypatch, kind):
    monkeypatch.setattr(mt, "TREE_ROWS", 150)
    monkeypatch.setattr(mt, "PAGE", 8)
    monkeypatch.setattr(vb, "BLOCK_ROWS", 90)
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 16)
    if kind == "clustered":  # queries beyond the bound of a broadcast, few held at once
        monkeypatch.setattr(vb, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(vb, "HELD", 1)
    df = frame(spark, made(kind))
    assert collections.Counter(tuple(r) for r in mt.top_k(df, "id % 20 = 0").collect()) == plain_top(made(kind), 20)
    assert collections.Counter(tuple(r) for r in hn.hard_negatives(df, "id % 20 = 0").collect()) == plain_negatives(made(kind), 20)


def test_components_beyond_doubles(spark):
    """Products are exact where doubles are not; scores that no long holds raise."""
    rng = np.random.default_rng(5)
    data = [(k, [float(a) for a in rng.integers(-(2**21), 2**21, 4)], k % 2) for k in range(40)] + [(100, [1.0, 2.0, 3.0, 1e-3], 0)]
    df = frame(spark, data, "double")
    assert collections.Counter(tuple(r) for r in mt.top_k(df, "id % 20 = 0", scale=256).collect()) == plain_top(data, 20, scale=256)
    assert collections.Counter(tuple(r) for r in hn.hard_negatives(df, "id % 20 = 0").collect()) == plain_negatives(data, 20)
    with pytest.raises(Exception, match="[Oo]verflow|too large|too big"):
        mt.top_k(frame(spark, [(0, [1e300], 0), (1, [1e300], 0)], "double"), "id % 20 = 0").collect()


def test_few_rows(spark):
    for data in ([], [(0, [1.0, 2.0], 1)], [(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 1), (2, [1.5, 0.1], 0)], [(1, [1.0], 0), (2, [1.0], 0)]):
        df = frame(spark, data)
        assert collections.Counter(tuple(r) for r in mt.top_k(df, "id % 20 = 0").collect()) == plain_top(data, 20)
        assert collections.Counter(tuple(r) for r in hn.hard_negatives(df, "id % 20 = 0").collect()) == plain_negatives(data, 20)


def test_tree_passes_over_far_rows():
    """Covering radii and parent distances keep most rows of clustered vectors from being scored; every node covers its rows."""
    rng = np.random.default_rng(2)
    x = np.floor((rng.standard_normal((40, 16))[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 16)) * 0.02) * 1024)
    tree = mt.Tree(x, np.arange(6000))
    assert sorted(tree.order.tolist()) == list(range(6000)) and max(tree.count) <= mt.PAGE
    import pyarrow as pa

    stored = mt.Tree.of(tree.to_table(pa.chunked_array([pa.array((x / 1024).tolist(), pa.list_(pa.float64()))])), 16, 1024)
    chosen = np.arange(0, 6000, 300)
    best = [vb.Best(10) for _ in chosen]
    products = stored.search(x[chosen], chosen, best)
    for k, found in zip(chosen.tolist(), best, strict=True):
        assert [(-s, i) for s, i in found.items] == sorted(((int(x[j] @ x[k]), j) for j in range(6000) if j != k), key=lambda r: (-r[0], r[1]))[:10]
    assert products < len(chosen) * 6000 / 2


def test_bounds_hold():
    rng = np.random.default_rng(8)
    x, a = np.floor(rng.standard_normal((3000, 30)) * 256), np.floor(rng.standard_normal((50, 30)) * 256)
    book = hn.Codebook(x[:1000], 30)
    low, high = book.bounds(a, *book.encode(x))
    score = a @ x.T
    assert ((low <= score) & (score <= high)).all() and (high - low).mean() < 4 * score.std()


def test_vector_queries(spark, duck):
    for run, sql in ((mt.op13_mtree_top_k, mt.ORACLE), (hn.op12_hard_negatives, hn.ORACLE)):
        got = run(spark, f"{DATA}/sf0.001")
        want = duck().sql(sql)
        assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(want.select(", ".join(got.columns)).fetchall())
