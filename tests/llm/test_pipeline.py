"""Each stage of the pipeline, and the whole of it, against plain Python."""

import collections
import math
import re

import numpy as np
import pytest
from helpers import DATA

import corpus_pipeline
from deploom.llm import quality

MARKS = set(b"!#$%&*+/<=>@[\\]^_`{|}~")
COMMON = set(b".,;:'\"()-?")


def plain_features(text):
    data = text.encode()
    if not data:
        return [0.0] * len(quality.FEATURES)
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    n, m, lines = len(data), max(1, len(words)), [x for x in data.split(b"\n") if x]
    share = lambda good: sum(map(good, data)) / n
    of_words = lambda good: sum(map(good, words)) / m
    pairs = {(words[k], words[k + 1]) for k in range(len(words) - 1)}
    return [
        math.log(1 + n), share(lambda b: 97 <= b <= 122), share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(MARKS.__contains__), share(COMMON.__contains__),
        share(lambda b: b == 32 or 9 <= b <= 13), 1 - len(text) / n, text.count("|") / n, text.count("!") / n, text.count("\n") / m, n / m, len(set(words)) / m,
        len(pairs) / (len(words) - 1) if len(words) > 1 else 1.0, max(collections.Counter(words).values(), default=0) / m, len(set(lines)) / max(1, len(lines)),
        of_words(lambda w: any(65 <= b <= 90 for b in w) and not any(97 <= b <= 122 for b in w)), of_words(lambda w: w[-1] in MARKS), of_words(lambda w: len(w) > 24),
    ]


def plain_score(model, text):
    x = plain_features(text or "")
    place = lambda edges, f: sum(e <= x[f] for e in edges[f])
    z = model.base + sum(model.tables[f][place(model.edges, f)] for f in range(len(x)))
    z += sum(values[place(model.coarse, a), place(model.coarse, b)] for (a, b), values in zip(model.pairs, model.pair_tables, strict=True))
    return 1 / (1 + math.exp(-z))


def exact_copies_out(docs):
    first = {}
    for i, t in sorted(docs.items()):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t), i)
    return {i: docs[i] for i in first.values()}


def near_copies_out(docs):
    ids, holders, shared, size = sorted(docs), collections.defaultdict(list), collections.Counter(), {}
    for i in ids:
        words = re.findall(rb"[^\x20\x09-\x0d]+", docs[i].encode().lower())
        own = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        size[i] = len(own)
        for s in own:
            shared.update((j, i) for j in holders[s])
            holders[s].append(i)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), both in shared.items():
        if both / (size[i] + size[j] - both) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: docs[i] for i in ids if root[i] == i}


def passages_out(docs):
    first, out = {}, {}
    for i in sorted(docs):
        data = docs[i].encode()
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], i)
    for i, t in docs.items():
        data = t.encode()
        gone, at, left = np.zeros(len(data), bool), 0, []
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < i:
                gone[k : k + 50] = True
        for c in t:
            width = len(c.encode())
            if not gone[at : at + width].all():
                left.append(c)
            at += width
        out[i] = "".join(left)
    return out


def texts_of(docs):
    found = docs.collect()
    out = {r.doc_id: r.text or "" for r in found}
    assert len(out) == len(found)
    return out


def plain_stages(spark, docs, sf):
    """What each stage but the last must leave; the tables of the model are those of the operator, scored a document at a time."""
    model = quality.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {i: t for i, t in texts_of(docs).items() if plain_score(model, t) >= quality.THRESHOLD}
    yield good
    for step in (exact_copies_out, near_copies_out, passages_out):
        good = step(good)
        yield good


def token_ids(docs):
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: e.ids + [1] for i, e in zip(docs, t.encode_batch(list(docs.values()), add_special_tokens=False), strict=True)}


def test_stages(spark):
    from test_text import checked_pieces

    sf = f"{DATA}/sf0.01"
    docs = start = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "suffix-array dedup", "packing"]
    sizes = []
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], plain_stages(spark, start, sf), strict=True):
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.schema.names == start.schema.names
        kept = texts_of(docs)
        assert kept == want, name
        sizes.append(len(kept))
        if name == "quality classifier":
            assert sum(i in kept for i, y in labels.items() if y == 1) >= 0.97 * sum(labels.values())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    checked_pieces(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), token_ids(kept))


def test_run(spark):
    from test_text import checked_pieces

    sf = f"{DATA}/sf0.001"
    *_, kept = plain_stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(kept)
    checked_pieces(rows, token_ids(kept))


@pytest.mark.parametrize("lost", ["rows", "labels"])
def test_nothing_to_work_on(spark, lost, tmp_path):
    """Empty tables, null texts, and columns beside those of documents."""
    data = [(1, "good words here", "z"), (2, None, "z"), (3, "", "z"), (4, "good  words here", "z"), (None, "an id is missing", "z")]
    docs = spark.createDataFrame([] if lost == "rows" else data, "doc_id long, text string, id string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "case")
    assert {r.doc_id for r in docs.collect()} == (set() if lost == "rows" else {1, 2, None})


def test_scores_are_those_of_the_tables(spark):
    sf = f"{DATA}/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(docs, labels)
    got = {r.doc_id: r.score for r in quality.op2_quality_gam(spark, sf).collect()}
    assert got == pytest.approx({i: plain_score(model, t) for i, t in texts_of(docs).items()}, abs=1e-9)


def test_trees_take_the_best_cuts():
    rng = np.random.default_rng(8)
    worth = lambda g, h: g.sum() ** 2 / (h.sum() + 1)

    def tree(g, h, depth):
        gains = [worth(g[:k], h[:k]) + worth(g[k:], h[k:]) - worth(g, h) for k in range(1, len(g))]
        if not depth or not gains or max(gains) <= 1e-9:
            return [g.sum() / (h.sum() + 1)] * len(g)
        k = int(np.argmax(gains)) + 1
        return tree(g[:k], h[:k], depth - 1) + tree(g[k:], h[k:], depth - 1)

    for n in (1, 2, 9, 40):
        g, h = rng.normal(size=n), rng.random(n)
        assert quality._leaves(g, h, 2) == pytest.approx(tree(g, h, 2))
    for shape in ((2, 2), (5, 3), (8, 8)):
        g, h = rng.normal(size=shape), rng.random(shape)
        cut = lambda a, i, j: [a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]]  # noqa: E731, B023
        best = max(((i, j) for i in range(1, shape[0]) for j in range(1, shape[1])), key=lambda p: sum(map(worth, cut(g, *p), cut(h, *p))))
        gain, steps = quality._quadrants(g, h)
        assert gain == pytest.approx(sum(map(worth, cut(g, *best), cut(h, *best))) - worth(g, h))
        assert all(s == pytest.approx(a.sum() / (b.sum() + 1)) for s, a, b in zip(cut(steps, *best), cut(g, *best), cut(h, *best), strict=True))
