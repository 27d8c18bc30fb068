"""Exact dedup through counting quotient filters (Pandey et al., 2017).

Each partition puts the 48-bit fingerprints of its texts into a counting quotient filter: the high 32 bits of a fingerprint are its
quotient, the low 16 bits the remainder kept in the quotient's run, and a counter goes with each remainder that occurs again. A filter is
emitted as blocks of neighbouring quotients, about 6 bytes for a fingerprint; blocks of one range merge without loss, as runs are sorted by
remainder: two filters interleave, and equal remainders add their counters. Fingerprints counted once are unique texts. The others go to
byte verification, which groups the normalised texts themselves, so a fingerprint shared by two texts by chance (a share of about
n / 2**48 of n texts) splits into two groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, small, table, text_of

#: Fingerprints that a merged block holds at most, about; the number of blocks follows the input.
BLOCK_FINGERPRINTS = 20_000
#: Fingerprints in a filter before it is emitted.
FILTER_FINGERPRINTS = 1 << 20
QUOTIENT_BITS, REMAINDER_BITS = 32, 16


class CountingQuotientFilter:
    """A filter in the order of (quotient, remainder).

    `occupied` has the quotients that have a run, `ends` tells of each remainder whether its run ends there, and `counters` belong to
    the remainders marked in `again`; the others count one.
    """

    def __init__(self, occupied: np.ndarray, ends: np.ndarray, remainders: np.ndarray, again: np.ndarray, counters: np.ndarray):
        self.occupied, self.ends, self.remainders, self.again, self.counters = occupied, ends, remainders, again, counters

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> "CountingQuotientFilter":
        """From fingerprints below 2**48 in any order, repeats included."""
        values, counts = np.unique(fingerprints, return_counts=True)
        return cls.of_sorted(values, counts)

    @classmethod
    def of_sorted(cls, values: np.ndarray, counts: np.ndarray) -> "CountingQuotientFilter":
        quotients = (values >> np.uint64(REMAINDER_BITS)).astype(np.uint32)
        ends = np.r_[quotients[1:] != quotients[:-1], True][: len(values)]
        again = counts > 1
        return cls(quotients[ends], ends, values.astype(np.uint16), again, counts[again].astype(np.uint64))

    def fingerprints(self) -> np.ndarray:
        run = np.cumsum(self.ends) - self.ends
        return (self.occupied[run].astype(np.uint64) << np.uint64(REMAINDER_BITS)) | self.remainders.astype(np.uint64)

    def counts(self) -> np.ndarray:
        out = np.ones(len(self.remainders), np.uint64)
        out[self.again] = self.counters
        return out

    def merge(self, other: "CountingQuotientFilter") -> "CountingQuotientFilter":
        """Lossless union: the runs of the one are set between those of the other, equal remainders of a quotient add their counters."""
        a, b, many, more = self.fingerprints(), other.fingerprints(), self.counts(), other.counts()
        at = np.searchsorted(a, b)
        shared = at < len(a)
        shared[shared] = a[at[shared]] == b[shared]
        many[at[shared]] += more[shared]
        fresh = ~shared
        place = at[fresh] + np.arange(int(fresh.sum()))
        own = np.ones(len(a) + len(place), bool)
        own[place] = False
        values, counts = np.empty(len(own), np.uint64), np.empty(len(own), np.uint64)
        values[own], values[place], counts[own], counts[place] = a, b[fresh], many, more[fresh]
        return self.of_sorted(values, counts)

    def blocks(self, block_bits: int):
        """(block, bytes) for every range of quotients that holds something; block_bits <= QUOTIENT_BITS."""
        owner = self.occupied >> np.uint32(QUOTIENT_BITS - block_bits) if block_bits else np.zeros(len(self.occupied), np.uint32)
        cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(owner) else np.zeros(1, np.int64)
        last = np.r_[0, np.flatnonzero(self.ends) + 1]
        seen = np.r_[0, np.cumsum(self.again)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = last[a], last[b]
            part = CountingQuotientFilter(self.occupied[a:b], self.ends[lo:hi], self.remainders[lo:hi], self.again[lo:hi], self.counters[seen[lo] : seen[hi]])
            yield int(owner[a]), part.pack()

    def pack(self) -> bytes:
        """Occupied quotients as steps, remainders in 16 bits, a bit for each end of a run and for each counter, and the counters."""
        head = np.array([len(self.occupied), len(self.remainders), len(self.counters)], "<u4")
        steps = np.diff(self.occupied, prepend=np.uint32(0)).astype("<u4")
        return b"".join(x.tobytes() for x in (head, steps, self.remainders.astype("<u2"), np.packbits(self.ends), np.packbits(self.again), self.counters.astype("<u8")))

    @classmethod
    def unpack(cls, data: bytes) -> "CountingQuotientFilter":
        runs, n, repeated = np.frombuffer(data, "<u4", 3).tolist()
        at = 12
        occupied = np.cumsum(np.frombuffer(data, "<u4", runs, at), dtype=np.uint32)
        at += 4 * runs
        remainders = np.frombuffer(data, "<u2", n, at)
        at += 2 * n
        bits = -(-n // 8)
        ends, again = (np.unpackbits(np.frombuffer(data, np.uint8, bits, at + k * bits), count=n).astype(bool) for k in range(2))
        return cls(occupied, ends, remainders, again, np.frombuffer(data, "<u8", repeated, at + 2 * bits))


def merge_all(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    """Filters merged in pairs, the results in pairs again."""
    while len(filters) > 1:
        filters = [filters[k].merge(filters[k + 1]) if k + 1 < len(filters) else filters[k] for k in range(0, len(filters), 2)]
    return filters[0]


def fingerprint(column):
    """48 bits of a hash of a text, as a long."""
    return F.shiftrightunsigned(F.xxhash64(column), 64 - QUOTIENT_BITS - REMAINDER_BITS)


def repeated_fingerprints(prints: DataFrame, column: str, total: int) -> DataFrame:
    """Distinct values of a long column of fingerprints that occur more than once (`fp`, `copies`), through merged filters."""
    bits = min(QUOTIENT_BITS, int(np.ceil(np.log2(max(1, total) / BLOCK_FINGERPRINTS + 1))))

    def build(batches):
        held, n = [], 0

        def flush():
            out = list(CountingQuotientFilter.of(np.concatenate(held)).blocks(bits))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["block", "filter"])

        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            if len(values):
                held.append(values)
                n += len(values)
            if n >= FILTER_FINGERPRINTS:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        whole = merge_all([CountingQuotientFilter.unpack(x) for x in group.column("filter").to_pylist()])
        return pa.table({"fp": pa.array(whole.fingerprints()[whole.again].astype(np.int64)), "copies": pa.array(whole.counters.astype(np.int64))})

    blocks = prints.select(column).mapInArrow(build, "block long, filter binary")
    return blocks.groupBy("block").applyInArrow(merge, "fp long, copies long")


def normalised(column):
    return F.regexp_replace(column, "[\\x20\\x09-\\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row of docs; texts are equal if identical after white-space folding.

    Null text: an empty text. Null ids: never preferred as keep_id; a group of only null ids has a null keep_id and keeps its rows.
    Repeated rows (same id and text): each is reported; they are one group, and all that carry the smallest id are kept.
    Very long texts are fingerprinted whole. Only id_col and text_col are read, so clashing names of other columns do no harm.
    """
    texts = docs.select(docs[id_col].alias("id"), normalised(text_of(docs, text_col)).alias("norm"))
    hashed = texts.select("id", fingerprint("norm").alias("fp"), F.sha2(F.encode("norm", "utf-8"), 256).alias("sha"))
    prints = materialize(hashed, "exact-prints")
    repeated = small(materialize(repeated_fingerprints(prints, "fp", prints.count()).select("fp"), "exact-repeated"), 16)
    # Byte verification: whole texts are the grouping key, combined before the shuffle.
    texts = texts.withColumn("fp", fingerprint("norm"))
    groups = texts.join(repeated, "fp", "left_semi").groupBy("norm").agg(F.min("id").alias("keep"), F.count("*").alias("size"))
    groups = groups.select(F.sha2(F.encode("norm", "utf-8"), 256).alias("sha"), "keep", "size")
    groups = materialize(groups, "exact-groups")
    flagged = prints.join(repeated.withColumn("again", F.lit(True)), "fp", "left")
    once = flagged.where("again is null").select("id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"), "sha")
    more = flagged.where("again").select("id", "sha").join(small(groups, 100), "sha").select("id", "keep", "size", "sha")
    out = once.unionByName(more)
    return out.select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies of an earlier text; columns as they are.

    Rows are told apart by id and text: a repeated id doesn't take a unique text along, and copies with a null id go if another row of their
    group has an id. Rows that repeat both the kept id and its text all stay, as exact_groups keeps them all.
    """
    gone = exact_groups(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(F.encode(normalised(text_of(docs, text_col)), "utf-8"), 256)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]) & (sha == gone["_sha"]), "left_anti")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
