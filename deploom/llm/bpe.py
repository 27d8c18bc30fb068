"""Byte-level BPE over the distinct words of a corpus.

Texts are cut into pre-tokens. Each batch of texts keeps its pre-tokens as positions in the batch's own list of words; the lists are
shuffled by word, each distinct word of the corpus is encoded once, its ids go back to the batches that hold it, and the texts are put
together by position. Decoding looks ids up in the table of token bytes, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, expand, materialize, squeeze, table, text_of, written_apart

#: Bytes of text in a batch, about; one text is never split over batches.
BATCH_BYTES = 32 << 20
#: Word positions in one row, so that no row grows with its text.
PIECE_WORDS = 1 << 19
#: Words of a task that go back to their batches at once.
FLUSH_WORDS = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a rank file (`base64 id` lines). Read on the driver and sent to tasks: a vocabulary is of fixed size."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoder(ranks: dict[bytes, int], pattern: str, added: dict[str, int] | None = None):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})


#: Characters up to which the encoder's own pattern matcher is safe: its stack ends at a run of about a million white-space characters.
SAFE_CHARS = 100_000


def token_ids(enc, pattern: str, added: dict[str, int], text: str) -> np.ndarray:
    """Ids of a whole text of any length, added tokens matched. Texts over SAFE_CHARS are split by a matcher that needs no stack, and their
    words are encoded one by one; the ids are the same."""
    if len(text) <= SAFE_CHARS:
        return enc.encode_to_numpy(text, allowed_special="all")
    import regex

    findall, known, out = regex.compile(pattern).findall, {}, []
    cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
    for part in cut.split(text) if cut else [text]:
        if part in added:
            out.append([added[part]])
            continue
        for word in findall(part):
            if word not in known:
                known[word] = enc._encode_single_piece(word)
            out.append(known[word])
    return np.fromiter((i for ids in out for i in ids), np.uint32)


def pack(codes: np.ndarray) -> bytes:
    """Non-negative numbers below 2**32 as four compressed planes of bytes (common words have small numbers)."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(codes, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def split_words(texts: DataFrame, pattern: str) -> DataFrame:
    """texts (id, text) as rows of three kinds: a word of a batch's list with its place; a text with its row and count of words; and a piece of
    the batch's positions, one text after the other."""
    names = ["batch", "word", "at", "id", "row", "n", "piece", "codes"]

    def run(batches):
        import regex

        findall = regex.compile(pattern).findall
        first = TaskContext.get().partitionId() << 24
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        done = held = 0
        words: dict[str, int] = {}
        ids: list = []
        found: list[np.ndarray] = []

        def rows(count: int, **columns):
            given = {"batch": [first + done] * count, **columns}
            return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(count, t) for c, t in zip(names, kinds, strict=True)], names)

        def flush():
            nonlocal words, ids, found, held, done
            flat = np.concatenate(found)
            by = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # common words get small numbers
            rank = np.empty(len(by), np.uint32)
            rank[by] = np.arange(len(by), dtype=np.uint32)
            listed = list(words)
            for a in range(0, len(by), 50_000):
                part = [listed[k] for k in by[a : a + 50_000].tolist()]
                yield rows(len(part), word=part, at=range(a, a + len(part)))
            yield rows(len(ids), id=ids, row=range(len(ids)), n=[len(x) for x in found])
            for k, a in enumerate(range(0, len(flat), PIECE_WORDS)):
                yield rows(1, piece=[k], codes=[pack(rank[flat[a : a + PIECE_WORDS]])])
            words, ids, found, held, done = {}, [], [], 0, done + 1

        for arrow in batches:
            kinds[3] = arrow.schema.field(0).type
            for i, t in zip(arrow.column(0).to_pylist(), arrow.column(1), strict=True):
                text = t.as_py()
                get = words.setdefault
                ids.append(i)
                found.append(np.fromiter((get(w, len(words)) for w in findall(text)), np.int32))
                held += len(text)
                if held >= BATCH_BYTES:
                    yield from flush()
        if ids:
            yield from flush()

    return texts.mapInArrow(run, f"batch long, word string, at int, id {texts.dtypes[0][1]}, row int, n long, piece int, codes binary")


def encode_texts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, finish, out_schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text, made by finish(id, word_ids) -> tuple, where word_ids are the id arrays of the text's words in order.

    Null texts are empty: they have no words. Null and repeated ids each keep their row. Only id_col and text_col are read.
    """
    texts = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    spark = docs.sparkSession
    path, schema = written_apart(split_words(texts, pattern).withColumn("part", F.when(F.col("word").isNotNull(), 0).otherwise(1)), "bpe-split", "part")
    split = spark.read.schema(schema)
    if texts.isEmpty():  # nothing was written
        return spark.createDataFrame([], out_schema)
    listed = split.parquet(f"{path}/part=0").select("word", "batch", "at") if has_words(spark, f"{path}/part=0") else spark.createDataFrame([], "word string, batch long, at int")

    wide = "<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4"
    width = np.dtype(wide).itemsize

    def encode(batches):
        """Rows sorted by word: each distinct word is encoded once, and its ids go to every batch that lists it, packed by batch."""
        enc = encoder(ranks, pattern)
        last, ids = None, b""
        to, at, found = [], [], []

        def flush():
            by, places = np.argsort(np.array(to), kind="stable"), np.array(at, np.int64)
            owner = np.array(to)[by]
            cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
            blobs = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                mine = by[a:b][np.argsort(places[by[a:b]])]
                own = [found[k] for k in mine.tolist()]
                blobs.append(squeeze(np.diff(places[mine], prepend=0).astype("<u4"), np.array([len(x) // width for x in own], "<u4"), np.frombuffer(b"".join(own), wide)))
            return pa.RecordBatch.from_arrays([pa.array(owner[cuts[:-1]], pa.int64()), pa.array(blobs, pa.binary())], ["held_by", "ids"])

        for batch in batches:
            to += batch.column(1).to_pylist()
            at += batch.column(2).to_pylist()
            for word in batch.column(0).to_pylist():
                if word != last:
                    # A word is one match of the pattern already; matching it again would exhaust the pattern's stack on a long run of white space.
                    last, ids = word, np.array(enc._encode_single_piece(word), wide).tobytes()
                found.append(ids)
            if len(to) >= FLUSH_WORDS:
                yield flush()
                to, at, found = [], [], []
        if to:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_words = listed.repartition(n, "word").sortWithinPartitions("word")
    known = materialize(sorted_words.mapInArrow(encode, "held_by long, ids binary"), "bpe-known")
    discard(spark, f"{path}/part=0")
    pieces = split.parquet(f"{path}/part=1").select("batch", "id", "row", "n", "piece", "codes")

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = [expand(x, "<u4", "<u4", wide) for x in left.column("ids").to_pylist()]
        ids: list = [b""] * sum(len(x[0]) for x in blobs)
        for steps, sizes, data in blobs:
            raw, end = data.astype("<u4").tobytes(), 0
            for k, size in zip(np.cumsum(steps).tolist(), (sizes.astype(np.int64) * 4).tolist(), strict=True):
                ids[k] = raw[end : end + size]
                end += size
        lookup = finish.prepare(ids)
        listed = right.filter(pa.compute.is_valid(right.column("row"))).sort_by("row")
        packed = right.filter(pa.compute.is_valid(right.column("piece"))).sort_by("piece").column("codes").to_pylist()
        codes = np.concatenate([np.zeros(0, np.int32), *[unpack(x) for x in packed]])
        ends = np.cumsum(listed.column("n").to_numpy())
        cuts = zip(listed.column("id").to_pylist(), np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)
        out = [finish(i, codes[a:b], lookup) for i, a, b in cuts]
        types = finish.types(right.schema.field("id").type)
        return pa.table({name: pa.array([r[k] for r in out], t) for k, (name, t) in enumerate(types)})

    return known.groupBy("held_by").cogroup(pieces.groupBy("batch")).applyInArrow(join_back, out_schema)


def has_words(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


class TokenIds:
    """Finisher: the ids of each text as an array."""

    def prepare(self, ids):
        return ids

    def types(self, id_type):
        return [("id", id_type), ("ids", pa.list_(pa.int32()))]

    def __call__(self, key, codes, ids):
        return key, np.frombuffer(b"".join([ids[c] for c in codes.tolist()]), "<i4")


class Digests:
    """Finisher of the query: counts and digests of a text's ids, and of the bytes that they decode to."""

    def __init__(self, token_bytes: list[bytes | None]):
        self.token_bytes = token_bytes

    def prepare(self, ids):
        arrays = [np.frombuffer(x, "<i4").tolist() for x in ids]
        counts = np.array([len(x) for x in arrays], np.int64)
        decimal = [",".join(map(str, x)).encode() for x in arrays]
        table = self.token_bytes
        return counts, decimal, [b"".join([table[i] for i in x]) for x in arrays]

    def types(self, id_type):
        return [("doc_id", id_type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def __call__(self, key, codes, lookup):
        counts, decimal, decoded = lookup
        where = codes.tolist()
        joined = hashlib.sha256(b",".join([decimal[c] for c in where])).hexdigest()
        return key, int(counts[codes].sum()), joined, hashlib.sha256(b"".join([decoded[c] for c in where])).hexdigest()


def token_table(ranks: dict[bytes, int]) -> list[bytes | None]:
    out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for every text."""
    kind = dict(docs.dtypes)[id_col]
    return encode_texts(docs, ranks, pattern, TokenIds(), f"id {kind}, ids array<int>", id_col, text_col).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) from arrays of ids, by the table of token bytes. A null array decodes to no bytes; an unknown id raises."""
    tokens = token_table(ranks)

    def run(batches):
        for batch in batches:
            out = [b"".join([tokens[i] for i in (x.as_py() or ())]) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "bytes"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {dict(encoded.dtypes)[id_col]}, bytes binary")


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents")
    return encode_texts(docs, ranks, public_tokenizers.PATTERN, Digests(token_table(ranks)), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
