import base64
import hashlib
import zlib

import numpy as np
import pytest
from helpers import DATA

from deploom.llm import bpe, packing, quality, suffix_dedup, warc_archive

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
SMALL = f"{DATA}/sf0.001"
HARD = [(1, None), (2, ""), (3, "it's  the　 x\x1c\x85 y\r\n\n z 'll!'s"), (3, "copy"), (None, "n"), (4, "a" * 150_000), (5, "<|endoftext|> 𝒳 ½ é́")]


def hard(spark):
    return spark.createDataFrame([(i, t, "w", 1) for i, t in HARD], "doc_id long, text string, word string, batch int")


def test_bpe_round_trip(spark):
    enc = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    encoded = bpe.encode_documents(hard(spark), RANKS, public_tokenizers.PATTERN)
    got = sorted([(r.doc_id, list(r.ids)) for r in encoded.collect()], key=str)
    assert got == sorted([(i, enc.encode_ordinary(t or "")) for i, t in HARD], key=str)
    back = bpe.decode_documents(encoded, RANKS)
    assert sorted([(r.doc_id, bytes(r.bytes).decode()) for r in back.collect()], key=str) == sorted([(i, t or "") for i, t in HARD], key=str)
    assert bpe.encode_documents(hard(spark).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_batches_share_words(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_BYTES", 4000)
    monkeypatch.setattr(bpe, "PIECE_WORDS", 100)
    monkeypatch.setattr(bpe, "FLUSH_WORDS", 300)
    enc = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in bpe.op7_word_bpe(spark, SMALL).collect():
        ids = enc.encode_ordinary(docs.pop(r.doc_id))
        text = enc.decode_bytes(ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest())
    assert not docs


def long_texts(n=1_000_000):
    """A long run of one kind of character between two letters, and one with an added token behind it."""
    return ["x" + " " * n + "y", "x" + "\n" * n + "y", "a" * n, " \t" * (n // 2) + "<|endoftext|> it's  é" + "\u3000" * 1000, "! " * (n // 2)]


def test_bpe_of_a_million_characters(spark, tmp_path):
    """Ids of op7 on runs that exhaust the library's pattern matcher: its merges on each match of the pattern."""
    import regex

    texts = long_texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    enc, words = bpe.encoder(RANKS, public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in bpe.op7_word_bpe(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        ids = [i for w in words.findall(t) for i in enc._encode_single_piece(w)]
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_packing_of_a_million_characters(spark, tmp_path):
    """Ids are those of tokenizers, which takes such texts."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = long_texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = {k: t.encode(x, add_special_tokens=False).ids + [1] for k, x in enumerate(texts)}
    checked_pieces(packing.op4_bm25_packing(spark, str(tmp_path)).collect(), ids)


def test_long_texts_have_the_ids_of_short_ones(monkeypatch):
    enc = bpe.encoder(RANKS, public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
    texts = [t or "" for _, t in HARD] + [r"it's <|endoftext|><|endoftext|>  é́\n\n x <|endoftext|"]
    want = [bpe.token_ids(enc, public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, t).tolist() for t in texts]
    monkeypatch.setattr(bpe, "SAFE_CHARS", -1)
    assert want == [bpe.token_ids(enc, public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, t).tolist() for t in texts]


def checked_pieces(rows, ids):
    """Each id in one piece, sequences gapless, padding none."""
    for key, doc in ids.items():
        own, at = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == key), 0
        for start, length, crc, n in own:
            assert (start, n, crc) == (at, len(doc), zlib.crc32(np.array(doc[at : at + length], "<u4").tobytes())) and length > 0
            at += length
        assert at == len(doc)
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert all(n <= packing.WINDOW and (n & (n - 1)) == 0 for n in by.values())


@pytest.mark.parametrize("shard", [3_000_000, 20_000])
def test_packing_query(spark, monkeypatch, shard):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    ids = {r.doc_id: e.ids + [1] for r, e in zip(docs, t.encode_batch([r.text for r in docs], add_special_tokens=False), strict=True)}
    checked_pieces(packing.op4_bm25_packing(spark, SMALL).collect(), ids)


def test_packing_cases(spark):
    enc = bpe.encoder(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    rows = packing.pack_with_public_vocabulary(hard(spark)).collect()
    assert sum(r.length for r in rows) == sum(len(enc.encode_ordinary(t or "")) + 1 for _, t in HARD)
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, None}
    assert packing.pack_with_public_vocabulary(hard(spark).limit(0)).count() == 0


def test_both_encoders_agree():
    """The rank encoder gives the ids of the tokenizer file for every character, in several surroundings."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = bpe.encoder(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    texts = ["".join(f"a{chr(c)}{chr(c)}1 {chr(c)}b" for c in range(k, min(k + 64, 0x30000)) if not 0xD800 <= c < 0xE000) for k in range(0, 0x30000, 64)]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == [enc.encode_ordinary(x) for x in texts]


def test_packing_matches_added_tokens(spark, tmp_path):
    """Ids are those of tokenizers with the JSON file as it is: the string of an added token is that token."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "  <|endoftext|><|endoftext|>\n x", "<|endoftext|", "a  <|endoftext|>  b", "plain it's  text\n\n", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = {k: e.ids + [1] for k, e in enumerate(t.encode_batch(texts, add_special_tokens=False))}
    assert 50256 in ids[0]
    checked_pieces(packing.op4_bm25_packing(spark, str(tmp_path)).collect(), ids)


def test_neighbours_share_words():
    idf = np.ones(100, np.float32)
    docs = [np.array([1, 2, 3] * 5), np.array([50, 51] * 5), np.array([1, 2, 4] * 5), np.array([60] * 10)]
    scores = packing.Bm25Index(docs, idf).scores(0)
    assert scores[2] > 0 == scores[1] == scores[3]
    first = [k for k, _, _, seq, _ in packing.pack_shard(docs, idf, window=32) if seq == 0]
    assert first[:2] == [0, 2]


def plain_bm25(docs, idf, seed):
    mean = sum(map(len, docs)) / len(docs)
    out = []
    for d in docs:
        score = 0.0
        for t in set(docs[seed].tolist()):
            tf = int((d == t).sum())
            if idf[t] > 0 and tf:
                score += float(idf[t]) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        out.append(score)
    return out


def test_windows_are_filled_in_order_of_bm25():
    """Against scores by the formula: each window has its seed, then the best unused documents, then, without a score, the first ones."""
    rng = np.random.default_rng(12)
    docs = [np.concatenate([rng.integers(0, 30, 3), (k % 6) * 10 + 40 + rng.integers(0, 10, int(rng.integers(2, 14)))]) for k in range(60)]
    df = np.array([sum(t in d for d in docs) for t in range(100)])
    idf = np.maximum(0.0, np.log((60 - df + 0.5) / (df + 0.5))).astype(np.float32)
    window = 40
    pieces = packing.pack_shard(docs, idf, window)
    total = sum(map(len, docs))
    left, unused, seed = [len(d) for d in docs], set(range(60)), None
    for seq in range(total // window):
        seed = min(unused) if seed is None else seed
        scores, want, room = plain_bm25(docs, idf, seed), [], window
        queue = [seed, *sorted((k for k in unused - {seed} if scores[k] > 0), key=lambda k: (-round(scores[k], 4), k)), *sorted(k for k in unused - {seed} if scores[k] <= 0)]
        seed = None
        for k in queue:
            take = min(room, left[k])
            want.append((k, take))
            left[k] -= take
            room -= take
            unused.discard(k)
            seed = k if left[k] else None
            if not room:
                break
        assert [(k, n) for k, _, n, q, _ in pieces if q == seq] == want
    assert total // window > 10


def removed(pairs):
    first = {}
    rank = lambda d: suffix_dedup.LAST if d is None else d
    for d, t in pairs:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, suffix_dedup.LAST), rank(d))
    out = []
    for d, t in pairs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < rank(d):
                gone[i : i + 50] = True
        edges = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), edges, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def test_suffix_query(spark, duck, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RANGE_ANCHORS", 3000)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "BLOCK_ANCHORS", 5000)
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in suffix_dedup.op5_suffix_dedup(spark, SMALL).collect()], key=str) == removed(pairs)
    assert sorted([tuple(r) for r in duck().sql(suffix_dedup.ORACLE).fetchall()], key=str) == removed(pairs)


def test_common_passage_is_split_over_ranges(spark, monkeypatch):
    """A passage of most documents is sampled as several splitters: its strings are on both sides of their boundaries."""
    monkeypatch.setattr(suffix_dedup, "RANGE_ANCHORS", 20)
    monkeypatch.setattr(suffix_dedup, "BLOCK_ANCHORS", 40)
    monkeypatch.setattr(suffix_dedup, "BLOCK_CONTEXTS", 30)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 400)
    rng = np.random.default_rng(6)
    p = "a common passage that nearly all of the documents hold somewhere in the midst of their own words "
    own = lambda: "".join(map(chr, rng.integers(97, 123, int(rng.integers(0, 60)))))
    pairs = [(int(i), own() + p[int(rng.integers(0, 12)) :] + own()) for i in rng.permutation(200)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(7)
    assert sorted([tuple(r) for r in suffix_dedup.removed_report(df).collect()], key=str) == removed(pairs)


def test_suffix_cases(spark):
    p = "the quick brown fox jumps over the lazy dog and runs away from it all, é ü again "
    pairs = [(5, p), (3, p * 2), (3, "x" + p), (None, p), (None, p + "z"), (9, None), (10, ""), (11, "a" * 500), (12, "a" * 60 + "b"), (13, "short"), (5, p), (14, p[:50]), (15, p[:49]), (16, "q" * 30 + p[10:70] + "w" * 30)]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in pairs], "doc_id long, text string, rank int, _spans int, spans int, copy int")
    assert sorted([tuple(r) for r in suffix_dedup.removed_report(df).collect()], key=str) == removed(pairs)
    cut = suffix_dedup.drop_repeated_passages(df)
    assert cut.columns == df.columns and {r.doc_id: r.text for r in cut.collect()}[16] == "q" * 30 + "w" * 30
    assert suffix_dedup.removed_report(df.limit(0)).count() == 0
    with pytest.raises(TypeError):
        suffix_dedup.removed_report(df.withColumn("doc_id", df["text"]))


def test_long_texts_are_cut_into_segments(monkeypatch):
    rng = np.random.default_rng(8)
    data = rng.integers(97, 100, 5000, dtype=np.uint8).tobytes() + b"a" * 300 + b"xyz" * 100
    starts, ends = np.array([0, 1000, 1030, 1100]), np.array([1000, 1030, 1100, len(data)])
    whole = suffix_dedup.anchors(data, starts, ends)
    for size in (64, 333, 1000):
        monkeypatch.setattr(suffix_dedup, "SEGMENT", size)
        assert all((a == b).all() for a, b in zip(whole, suffix_dedup.anchors(data, starts, ends), strict=True))


def test_multikey_order():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000, dtype=np.uint8).tobytes() + b"ab" * 200
    at = np.arange(len(data) - 50)
    order, edge = suffix_dedup.multikey_order(data, at)
    strings = [data[k : k + 50] for k in order.tolist()]
    assert strings == sorted(strings)
    assert edge.tolist() == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]


def test_archive_round_trip(spark, tmp_path):
    data = [(1, "u", ""), (2, None, None), (3, "x", "ab\r\n\r\ncd"), (4, "x", "ab\r\n\r\ncd"), (4, "x", "ab\r\n\r\ncd"), (None, "x", "z"), (None, "x", "z"), (7, "a\r\nb", "é" * 100_000), (None, "n", "ab\r\n\r\ncd")]
    df = spark.createDataFrame([(*d, "k", "d") for d in data], "page_id long, url string, html string, digest string, first_id string")
    html = {i: (t or "").encode() for i, _, t in data if i}
    for name, size, bound in (("one", 32 << 20, 16 << 20), ("small", 10, 0)):
        path = str(tmp_path / name)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(warc_archive, "BROADCAST_BYTES", bound)
            warc_archive.write_archive(df, path, file_bytes=size)
        out = warc_archive.read_records(spark, path).collect()
        want = [(1, "response", None), (2, "revisit", "1"), (3, "response", None), (4, "revisit", "3"), (4, "revisit", "3"), (7, "response", None), (None, "response", None), (None, "response", None), (None, "revisit", "3")]
        assert sorted([(r.page_id, r.record_type, r.refers_to) for r in out], key=str) == sorted(want, key=str)
        assert warc_archive.read_payloads(spark, path).count() == 4
        for r in out:
            (headers, block), = warc_archive.parse_records(bytes(r.record))
            assert headers["WARC-Type"] == r.record_type and len(block) == int(headers["Content-Length"])
            body = bytes(block).split(b"\r\n\r\n", 1)[1]
            if r.page_id:
                assert body == (html[r.page_id] if r.record_type == "response" else b"") and r.payload_bytes == len(html[r.page_id])
                assert r.payload_digest == base64.b32encode(hashlib.sha1(html[r.page_id]).digest()).decode()
        with pytest.raises(ValueError):
            list(warc_archive.parse_records(bytes(out[0].record)[:-1]))


def test_altered_records_raise():
    head = warc_archive.record_head(1, "u", warc_archive.b32_sha1(b"abc"), "response", None, 3)
    assert warc_archive.rebuilt(head, b"abc")[0] == head + b"abc" + warc_archive.END
    for bad_head, payload in ((head, b"abd"), (head, b"abcd"), (head.replace(b"Length: 3", b"Length: 4"), b"abc"), (head[:-2], b"abc")):
        with pytest.raises(ValueError):
            warc_archive.rebuilt(bad_head, payload)


def test_archive_least_size_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    warc_archive.write_archive(df, str(tmp_path / "a"), min_revisit=3)
    assert sorted((r.page_id, r.record_type) for r in warc_archive.read_records(spark, str(tmp_path / "a")).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    warc_archive.write_archive(df.limit(0), str(tmp_path / "none"))
    assert warc_archive.read_records(spark, str(tmp_path / "none")).count() == 0


def test_archive_of_any_ids(spark, tmp_path):
    """Ids that would break a header come back as they are."""
    ids = ["a\r\nX: y", "b>", "c %41 é", "d"]
    df = spark.createDataFrame([(i, "u", h) for i in ids for h in (i, "same")], "page_id string, url string, html string")
    warc_archive.write_archive(df, str(tmp_path / "a"))
    out = warc_archive.read_records(spark, str(tmp_path / "a")).collect()
    assert len(out) == 8 and sorted((r.page_id, r.refers_to) for r in out if r.refers_to is not None) == [(i, ids[0]) for i in ids[1:]]


def test_archive_query(spark, duck):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    want = {(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == i else "revisit", None if first[p] == i else first[p]) for i, p in pages.items()}
    out = warc_archive.op6_warc_archive(spark, SMALL)
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()} == want
    assert {tuple(r) for r in duck().sql(warc_archive.ORACLE).select("page_id, payload_bytes, payload_digest, record_type, refers_to").fetchall()} == want


def test_quality_held_out(spark):
    sf = f"{DATA}/sf0.01"
    out = {r.doc_id: r for r in quality.op2_quality_gam(spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r.score <= 1 for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for i, r in out.items())
    unseen = [(out[i].predicted, y) for i, y in labels if out[i].held_out]
    assert len(unseen) > 50 and np.mean([p == y for p, y in unseen]) > 0.95


def test_repeated_ids_teach_once(spark):
    """However many rows have a labelled id, one is fitted on."""
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(k, f"other {k}") for k in range(2, 40)], "doc_id long, text string").repartition(4)
    once = docs.groupBy("doc_id").agg({"text": "min"}).toDF("doc_id", "text")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 40)], "doc_id long, quality int, toxic int")
    a, b = quality.learn(docs, labels), quality.learn(once, labels)
    assert a.base == b.base and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_quality_cases(spark):
    docs = hard(spark)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (99, 0)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    assert quality.score_rows(docs, model).count() == len(HARD)
    assert quality.score_rows(docs, quality.AdditiveModel()).where("score = 0.5").count() == len(HARD)
    assert quality.drop_low_quality(docs, labels).columns == docs.columns
    x = np.random.default_rng(0).random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality.fit(x, y, n_pairs=3).score(x) > 0.5) == y).mean() > 0.95  # only a pair can tell
    assert len(quality.features("")) == len(quality.FEATURES) == len(quality.features("a b"))


def test_suffix_blocks_grow_with_ranges():
    """A block is sent to each range, so messages don't shrink as both grow, up to the largest block."""
    from deploom.llm import suffix_dedup as s

    assert s.block_sizes(1) == (s.BLOCK_ANCHORS, s.BLOCK_CONTEXTS)
    for ranges in (1000, 1700):
        anchors, contexts = s.block_sizes(ranges)
        assert anchors >= s.MESSAGE_ANCHORS * ranges and contexts >= s.MESSAGE_CONTEXTS * ranges
    assert s.block_sizes(10**6) == (s.LARGEST_BLOCK * s.BLOCK_ANCHORS, s.LARGEST_BLOCK * s.BLOCK_CONTEXTS)
