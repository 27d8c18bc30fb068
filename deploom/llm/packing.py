"""Lexical retrieval packing: a sharded BM25 inverted index returns unused neighbours for each seed, which greedily fill its window.

Texts are tokenised once and written. Counts over all documents (document frequencies of tokens, tokens in all) weight the index; the table
of frequencies has a row for each token of the vocabulary at most. Shards hold about SHARD_TOKENS tokens: documents are laid out by a
min-hash of their token trigrams, so that texts that share passages meet, and the layout is cut evenly; a common min-hash spreads over
as many shards as its tokens need, by the hash of the document. A task indexes one shard at a time.

Within a shard whole windows are cut off long documents; each remainder is a seed or a neighbour. A window starts with a seed, takes its
best unused neighbours in order of score, and cuts the last one to fit; what was cut off seeds the next window. So every window is full
but for a shard's last, which is dealt to sequences whose lengths are powers of two.
"""

from __future__ import annotations

import json
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, load_ranks, token_ids
from .common import materialize, table, text_of

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 3_000_000
SIGNATURES = 1 << 12
K1, B = 1.2, 0.75


def signature(ids: np.ndarray) -> int:
    """Min-hash of the token trigrams, folded to SIGNATURES values."""
    x = ids.astype(np.uint64)
    if len(x) > 2:
        x = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return int((int(x.min()) * 0x9E3779B97F4A7C15 >> 40) % SIGNATURES) if len(x) else 0


def highest(ranks: dict[bytes, int], added: dict[str, int]) -> int:
    return max([*ranks.values(), *added.values()], default=0)


def tokenise(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str, added: dict[str, int]) -> DataFrame:
    """Rows (id, ids, n, sig) of documents, ids as little-endian 16-bit numbers with END_ID at the end, and rows (n, token) of token counts by document."""
    top = highest(ranks, added)
    wide = "<u2" if top < 1 << 16 else "<u4"
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    names = ["id", "ids", "n", "sig", "token"]

    def run(batches):
        enc = encoder(ranks, pattern, added)
        seen = np.zeros(top + 2, np.int64)
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                blobs, sizes, signs = [], [], []
                for t in part.column(1):
                    found = token_ids(enc, pattern, added, t.as_py())
                    ids = np.empty(len(found) + 1, wide)
                    ids[:-1], ids[-1] = found, END_ID
                    seen[np.unique(ids)] += 1
                    blobs.append(ids.tobytes())
                    sizes.append(len(ids))
                    signs.append(signature(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.int32()), pa.nulls(len(sizes), pa.int32())], names)
        token = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(token), kind), pa.nulls(len(token), pa.binary()), pa.array(seen[token]), pa.nulls(len(token), pa.int32()), pa.array(token, pa.int32())], names)

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, ids binary, n long, sig int, token int")


class Bm25Index:
    """Inverted index of one shard's pieces. idf is zero for tokens in more than half of all documents."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray):
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        owner = np.repeat(np.arange(n), lengths)
        token = np.concatenate(pieces).astype(np.int64)
        useful = idf[token] > 0
        key = token[useful] * n + owner[useful]
        key, tf = np.unique(key.astype(np.uint32) if len(idf) * n < 1 << 32 else key, return_counts=True)
        key = key.astype(np.int64)
        token, piece = key // n, key % n
        tf = tf.astype(np.float32)
        norm = K1 * (1 - B + B * lengths[piece] / max(1.0, lengths.mean()))
        self.weight = (idf[token] * tf * (K1 + 1) / (tf + norm)).astype(np.float64)
        self.piece = piece.astype(np.intp)
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        ends = np.r_[first[1:], len(token)]
        row = np.repeat(np.arange(len(first)), ends - first)
        order = np.argsort(piece, kind="stable")
        self.rows, self.row_ends = row[order], np.searchsorted(piece[order], np.arange(n + 1))
        self.first, self.ends = first, ends
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every piece for the distinct tokens of the seed, but for tokens that no other piece has."""
        rows = self.rows[self.row_ends[seed] : self.row_ends[seed + 1]]
        rows = rows[self.ends[rows] > self.first[rows] + 1]
        if not len(rows):
            return np.zeros(self.n)
        lists = [slice(a, b) for a, b in zip(self.first[rows].tolist(), self.ends[rows].tolist(), strict=True)]
        return np.bincount(np.concatenate([self.piece[x] for x in lists]), np.concatenate([self.weight[x] for x in lists]), self.n)


def best_first(scores: np.ndarray, left: np.ndarray, room: int) -> list[int]:
    """Pieces by falling score, as many as fill the room; pieces without a score are none."""
    k = 16
    while True:
        best = np.argpartition(-scores, k)[:k] if k < len(scores) else np.arange(len(scores))
        best = best[scores[best] > 0]
        best = best[np.lexsort((best, -scores[best]))]
        full = int(np.searchsorted(np.cumsum(left[best]), room)) + 1
        if full <= len(best) or len(best) < k:
            return best[:full].tolist()
        k *= 4


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces; every id of every document is in one piece."""
    out, seq = [], 0
    starts, rest = [], []
    for k, ids in enumerate(docs):
        whole = len(ids) // window
        for w in range(whole):
            out.append((k, w * window, window, seq, 0))
            seq += 1
        if len(ids) % window:
            starts.append([k, whole * window])
            rest.append(ids[whole * window :])
    if not rest:
        return out
    index = Bm25Index(rest, idf)
    left = np.array([len(r) for r in rest], np.int64)
    unused = np.ones(len(rest), bool)
    total, cursor, seed = int(left.sum()), 0, -1
    while total >= window:
        if seed < 0:
            while not unused[cursor]:
                cursor += 1
            seed = cursor
        room, queue, scored, now = window, [seed], False, cursor
        following = -1
        first_seed = seed
        while room:
            if not queue:
                if not scored:
                    scored = True
                    queue = best_first(index.scores(first_seed) * unused, left, room)
                if not queue:
                    while not unused[now]:
                        now += 1
                    queue = [now]
            piece = queue.pop(0)
            take = min(room, int(left[piece]))
            k, start = starts[piece]
            out.append((k, start, take, seq, window - room))
            room -= take
            total -= take
            left[piece] -= take
            starts[piece][1] += take
            unused[piece] = False
            if left[piece]:
                following = piece
        seq += 1
        seed = following
    # The rest of the shard is shorter than a window: sequences of falling powers of two need no padding.
    queue = ([seed] if seed >= 0 else []) + [int(i) for i in np.flatnonzero(unused)]
    room = offset = 0
    for piece in queue:
        while left[piece]:
            if not room:
                if offset:
                    seq += 1
                offset, room = 0, 1 << (total.bit_length() - 1)
            take = min(room, int(left[piece]))
            out.append((starts[piece][0], starts[piece][1], take, seq, offset))
            starts[piece][1] += take
            left[piece] -= take
            room -= take
            offset += take
            total -= take
    return out


def pack_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves.

    Null texts are empty: one piece of the closing id. Repeated rows and null ids are packed like any other row. Very long texts are cut
    into whole windows. Only id_col and text_col are read. added: tokens that are cut out of a text before all else, and their ids.
    """
    added = added or {}
    tokens = materialize(tokenise(docs, ranks, pattern, id_col, text_col, added), "pack-tokens")
    # The place in its file tells repeated rows apart, and rows of null ids, so that no shard gets all of them.
    texts = tokens.select("*", F.col("_metadata.row_index").alias("at")).where("token is null")
    # Bounded by the vocabulary and by SIGNATURES.
    counts = tokens.where("token is not null").groupBy("token").agg(F.sum("n").alias("df")).toArrow()
    layout = texts.groupBy("sig").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")).orderBy("sig").toPandas()
    n_docs = int(layout["docs"].sum())
    df = np.zeros(highest(ranks, added) + 2)
    df[counts.column("token").to_numpy()] = counts.column("df").to_numpy()
    idf = np.maximum(0.0, np.log((n_docs - df + 0.5) / (df + 0.5))).astype(np.float32)
    before = np.r_[0, np.cumsum(layout["tokens"].to_numpy(np.int64))]
    shards = max(1, int(before[-1]) // SHARD_TOKENS)
    spark = docs.sparkSession
    places = spark.createDataFrame([(int(s), int(b), int(t)) for s, b, t in zip(layout["sig"], before, layout["tokens"], strict=False)], "sig int, before long, span long")
    spread = F.pmod(F.xxhash64("id", "n", "at"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    shard = F.least(F.floor((F.col("before") + spread * F.col("span")) / F.lit(max(1.0, int(before[-1]) / shards))), F.lit(shards - 1)).cast("long")
    placed = texts.join(F.broadcast(places), "sig").select(shard.alias("shard"), "id", "n", "ids")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(n, "shard").sortWithinPartitions("shard", "id", "n")
    wide = "<u2" if highest(ranks, added) < 1 << 16 else "<u4"
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches):
        now, keys, held, kind = None, [], [], pa.int64()

        def flush():
            pieces = pack_shard(held, idf)
            for a in range(0, len(pieces), 4000):
                cut = [(keys[k], s, m, held[k][s : s + m].astype("<u4").tobytes(), len(held[k]), (now << 32) + q, o) for k, s, m, q, o in pieces[a : a + 4000]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c[0] for c in cut], kind), pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.int64()), pa.array([zlib.crc32(c[3]) for c in cut], pa.int64()),
                     pa.array([c[4] for c in cut], pa.int64()), pa.array([c[5] for c in cut], pa.int64()), pa.array([c[6] for c in cut], pa.int64()), pa.array([c[3] for c in cut], pa.binary())], names)

        for batch in batches:
            kind = batch.schema.field(1).type
            for shard_no, key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if shard_no != now:
                    if held:
                        yield from flush()
                    now, keys, held = shard_no, [], []
                keys.append(key)
                held.append(np.frombuffer(ids.as_py(), wide))
        if held:
            yield from flush()

    return dealt.mapInArrow(run, f"{id_col} {dict(texts.dtypes)['id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer file, which tokenizers matches in texts; those with options that the rank encoder lacks raise."""
    tokens = json.loads(Path(path).read_text())["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
        raise ValueError(f"added tokens of {path} are matched by other rules than their text")
    return {t["content"]: t["id"] for t in tokens}


def pack_with_public_vocabulary(docs: DataFrame, match_added: bool = False) -> DataFrame:
    """Packing by the ids of byte_bpe_50k. The rank file holds the vocabulary of byte_bpe_50k.json, and the rank encoder gives the same ids
    (the tests compare them) about four times faster. match_added: the added tokens of the JSON file are matched in texts as tokenizers does
    by default (op4 and the pipeline); else their strings are ordinary text, as with its encode_special_tokens."""
    import public_tokenizers

    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json")) if match_added else {}
    packed = pack_documents(docs, load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, added=added)
    return packed.drop("ids")


def op4_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_with_public_vocabulary(table(spark, sf_dir, "documents"), match_added=True)
