import collections
import hashlib
import re
import zlib

import numpy as np
from helpers import DATA, rows
from pyspark.sql import functions as F

from deploom.llm import exact_dedup, sharding, url_filter
from deploom.llm.exact_dedup import CountingQuotientFilter

DOCS = "doc_id long, text string, norm string, fp long"


def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    data = [(5, "a  b"), (3, "a\tb"), (3, "a\tb"), (None, "a b"), (7, None), (8, ""), (9, " "), (10, "x" * 200_000), (11, "x" * 200_000), (None, "q"), (12, "é b"), (13, "é b")]
    return spark.createDataFrame([(i, t, "n", 1) for i, t in data], DOCS)


def test_filter_is_lossless():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 2**48, 5000), rng.integers(0, 40, 900) << 16, rng.integers(0, 1 << 18, 3000)]).astype(np.uint64)
    values = np.concatenate([values, values[:700], values[:50], np.array([0, 0, 2**48 - 1], np.uint64)])
    parts = [CountingQuotientFilter.of(p) for p in np.array_split(rng.permutation(values), 7)]
    for bits in (0, 6, 32):
        by_block = collections.defaultdict(list)
        for p in parts:
            for block, packed in p.blocks(bits):
                by_block[block].append(CountingQuotientFilter.unpack(packed))
        got = {}
        for blocks in by_block.values():
            f = exact_dedup.merge_all(blocks)
            assert (np.diff(f.fingerprints().astype(np.int64)) > 0).all() and len(f.occupied) == f.ends.sum()
            got |= dict(zip(f.fingerprints().tolist(), f.counts().tolist(), strict=True))
        assert got == collections.Counter(values.tolist())
    spread = CountingQuotientFilter.of(rng.integers(0, 2**48, 100_000).astype(np.uint64))
    assert sum(len(x) for _, x in spread.blocks(0)) < 6.5 * 100_000


def expected_groups(pairs):
    groups = collections.defaultdict(list)
    for i, t in pairs:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = []
    for i, t in pairs:
        n = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        keep = min((x for x in groups[n] if x is not None), default=None)
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(spark):
    df = docs(spark)
    got = sorted([tuple(r) for r in exact_dedup.exact_groups(df).collect()], key=str)
    assert got == expected_groups([(r.doc_id, r.text) for r in df.collect()])
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [3, 3, 7, 9, 10, 12, 13]
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_exact_copies_go_by_row(spark):
    """A repeated id takes no unique text along; a copy with a null id goes, a unique text with a null id stays."""
    data = [(1, "a"), (2, "a"), (2, "unique"), (None, "a"), (None, "other"), (3, "a  b"), (4, "a b")]
    kept = exact_dedup.drop_exact_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in kept), key=str) == sorted([(1, "a"), (2, "unique"), (None, "other"), (3, "a  b")], key=str)


def test_exact_query(spark, duck):
    got = exact_dedup.op10_exact_dedup(spark, f"{DATA}/sf0.001").toPandas()
    assert rows(got) == rows(duck().sql(exact_dedup.ORACLE).df())


def test_large_repeated_side_takes_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr("deploom.llm.common.BROADCAST_BYTES", 0)
    df = docs(spark)
    assert sorted([tuple(r) for r in exact_dedup.exact_groups(df).collect()], key=str) == expected_groups([(r.doc_id, r.text) for r in df.collect()])


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding_query(spark, duck):
    got = sharding.op9_jump_sharding(spark, f"{DATA}/sf0.001").toPandas()
    want = duck().sql(sharding.ORACLE).df()
    assert rows(got) == rows(want)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    for r in got.itertuples():
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        key = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16)
        assert (r.shard, r.grown_shard) == (jump(key, 40), jump(key, 41))


def test_sharding_cases(spark):
    data = [(1, "a", "z"), (1, "a", "z"), (None, None, "z"), (None, "", "z"), (2, "é", "z")]
    df = spark.createDataFrame([(*d, 6, 7, 8) for d in data], "doc_id long, text string, shard string, _run int, r int, before int")
    out = sharding.number_slots(sharding.shard_rows(df, "doc_id", 3), "shard", ["doc_id", "text"], 5).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 3)
        assert (r._run, r.r, r.before) == (6, 7, 8)
    assert len(out) == 5 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_rows(df.limit(0), "doc_id", 3).count() == 0
    big = spark.range(3000).withColumnRenamed("id", "doc_id")
    moved = sharding.shard_rows(big, "doc_id", 500).where("shard <> grown_shard").collect()
    assert all(r.grown_shard == 500 for r in moved) and len(moved) < 30


def test_slots_of_hot_keys(spark):
    """A third of all rows repeats one row, a third has no id, some have no shard: numbers are gapless, and runs hold few distinct rows."""
    data = [(7, "same")] * 300 + [(None, f"t{k}") for k in range(300)] + [(k, "x") for k in range(300)]
    df = sharding.shard_rows(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", 3)
    df = df.withColumn("shard", F.when(F.col("text") != "t5", F.col("shard")))
    out = sharding.number_slots(df, "shard", ["doc_id", "text"], len(data)).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert len(out) == 900 and by.pop(None) == [None]
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    maps = spark.sql("select id as doc_id, map('a', id % 2) as m, 0 as shard from range(20)")
    assert sorted(r.slot for r in sharding.number_slots(maps, "shard", ["doc_id"], 20).collect()) == list(range(20))


def test_hot_urls(spark):
    """Most captures are of one URL, or of none: each comes back once, judged."""
    entries = spark.sql("select 'a.com' as pattern, 'block' as action, date'2024-01-01' as listed_on")
    urls = "case when id % 3 = 0 then 'http://a.com/' when id % 3 = 1 then null else concat('http://b.com/', id) end"
    captures = spark.sql(f"select id, {urls} as url, date'2024-02-01' as fetched_on from range(900)")
    out = url_filter.judge(captures, entries).collect()
    assert sorted((r.id, r.blocked) for r in out) == [(k, k % 3 == 0) for k in range(900)]


def test_url_query(spark, duck):
    got = url_filter.op1_temporal_url_filter(spark, f"{DATA}/sf0.001").toPandas()
    want = duck().sql(url_filter.ORACLE).df()
    fix = lambda d: d.assign(fetched_on=d.fetched_on.astype(str).str[:10], listed_since=d.listed_since.astype(str).str[:10].replace("NaT", "None"))
    assert rows(fix(got)) == rows(fix(want))


def test_url_cases(spark):
    entries = spark.createDataFrame([("a.com", "block", "2024-01-01"), ("a.com", "remove", "2024-02-01"), ("a.com/x", "allow", "2024-01-10"), ("b.a.com", "block", "2024-01-05"), ("a.com", "allow", None), (None, "block", "2024-01-01"), ("t.com", "allow", "2024-01-01"), ("t.com", "block", "2024-01-01")], "pattern string, action string, listed_on string")
    entries = entries.selectExpr("pattern", "action", "cast(listed_on as date) listed_on")
    captures = spark.createDataFrame(
        [(1, "http://a.com/y", "2023-12-31"), (2, "http://A.com:80/y", "2024-01-01"), (3, "https://u@a.com/x/z?q", "2024-01-10"), (4, "http://b.a.com", "2024-01-09"), (5, "http://a.com/", "2024-02-01"),
         (6, None, "2024-01-05"), (7, "http://a.com/", None), (8, "no url", "2024-01-05"), (9, "http://t.com/", "2024-01-05"), (9, "http://t.com/", "2024-01-05"), (10, "http://xa.com/", "2024-01-05"), (11, "http://a.com/xx", "2024-01-11")],
        "id int, url string, d string",
    ).selectExpr("id", "url", "cast(d as date) fetched_on", "'c' as blocked", "1 as _key", "2 as _b", "3 as _bu", "4 as _u", "5 as _row")
    out = url_filter.judge(captures, entries).select("id", "blocked", "matched_pattern").collect()
    assert sorted(map(tuple, out)) == [(1, False, None), (2, True, "a.com"), (3, False, "a.com/x"), (4, True, "b.a.com"), (5, False, None), (6, False, None), (7, False, None), (8, False, None), (9, True, "t.com"), (9, True, "t.com"), (10, False, None), (11, True, "a.com")]
    assert url_filter.judge(captures, entries).columns == ["id", "url", "fetched_on", "_key", "_b", "_bu", "_u", "_row", "matched_pattern", "listed_since", "blocked"]
    assert url_filter.judge(captures.limit(0), entries.limit(0)).count() == 0
