import collections
import hashlib
import zlib

import numpy as np
import pytest
from helpers import DATA

from deploom.llm import periodic_runs as pr

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def plain_runs(words, min_exp=4, min_words=6):
    """Every lag and stretch by the definition, word by word."""
    n, out = len(words), []
    for q in range(1, n // min_exp + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if size >= max(min_words, min_exp * q) and not any(all(words[k] == words[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out)


def plain_row(key, text):
    words = (text or "").encode().split()
    if key is not None and words and zlib.crc32(str(key).encode()) % 10 == 0:
        g, n = zlib.crc32(str(key).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    from fractions import Fraction

    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{a},{size},{q}\n" for a, size, q in runs)
    return key, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("direct", [256, 1])
@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_runs_by_definition(monkeypatch, direct, letters):
    """Random words over few letters, with blocks that repeat, in ranges of lags and whole."""
    monkeypatch.setattr(pr, "DIRECT", direct)
    rng = np.random.default_rng(letters)
    for _ in range(120):
        parts = []
        for _ in range(rng.integers(1, 5)):
            parts += list(rng.integers(0, letters, rng.integers(1, 12))) * int(rng.integers(1, 9))
        ids = np.array(parts, np.int32)
        want = plain_runs(ids.tolist())
        assert sorted(pr.find_runs(ids)) == want
        k = max(1, len(ids) // 10)
        assert sorted(r for a in range(1, len(ids) // 4 + 1, k) for r in pr.find_runs(ids, a, a + k - 1)) == want


def cases():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in rng.integers(0, 40, 400)]
    long = " ".join(words)
    data = [(0, None), (1, ""), (2, " \n\t"), (3, "a"), (4, "a " * 6), (5, "a b " * 4), (6, "a\x1ca a a a a"), (7, "é É " * 9), (7, "é É " * 9), (8, (long + " ") * 5), (None, "x y z " * 5), (None, None), (9, "x" * 9000)]
    data += [(100 + k, " ".join(words[: 3 + 7 * k])) for k in range(50)]
    return data + [(1000, "w " * 3000), (1001, "w " * 900 + "b " + "w " * 900), (1002, ("p q " * 30 + "r ") * 12)]


@pytest.mark.parametrize("chars", [1 << 18, 500])
def test_run_cases(spark, monkeypatch, chars):
    monkeypatch.setattr(pr, "WHOLE_CHARS", chars)
    monkeypatch.setattr(pr, "LAGS", 16)
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in cases()], "doc_id long, text string, no string, runs int").repartition(3)
    got = pr.periodic_runs(df, pr.RunReport(), SCHEMA, pr.plant_runs)
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(plain_row(*c) for c in cases())
    assert pr.periodic_runs(df.limit(0), pr.RunReport(), SCHEMA).count() == 0


def test_runs_query(spark, duck):
    got = collections.Counter(tuple(r) for r in pr.op11_periodic_runs(spark, f"{DATA}/sf0.001").collect())
    assert got == collections.Counter(duck().sql(pr.ORACLE).fetchall())
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()
    short = {r.doc_id: plain_row(r.doc_id, r.text) for r in docs if len(r.text or "") < 3000}
    assert len(short) > 50 and all(got[row] == 1 for row in short.values())
    assert sum(r[1] > 0 for r in got) >= len(docs) // 25


def test_very_long_text_of_one_word():
    """Lags that are multiples of a found period cost little."""
    ids = np.zeros(300_000, np.int32)
    assert pr.find_runs(ids) == [(0, 300_000, 1)]
    assert pr.find_runs(ids, 20_000, 75_000) == []
