"""Periodic runs of words: all lags of a text are scanned at once, and lag ranges of long texts are spread over the cluster.

A text becomes an array of word ids, and a lag q compares the array with itself shifted by q. True stretches of at least (min_exp - 1) * q are runs
of period q, unless q divided by one of its primes is a period of the stretch too. Lags up to n / min_exp can hold a run.

Small lags are compared whole. For the others the words at multiples of the lag are compared first, for all lags in one step: a run of
exponent min_exp holds min_exp - 1 such comparisons in a row, so a lag without them has no run, and one that has them is compared in full
around them only. This drops no run, and takes n log n comparisons of a text instead of n squared. Stretches that lie in a run of smaller
period dividing the lag are no runs and are passed over, so that texts of one repeated word cost no more.

Texts of up to WHOLE_CHARS characters are scanned whole where they are read, with no shuffle. Longer ones are written, and each range of lags is a row
of its own, dealt over all tasks; runs come back as rows and are grouped by text.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions, slices, table, text_of
from .sharding import crc_steps

MIN_EXP, MIN_WORDS = 4, 6
#: Characters up to which a text is scanned in one piece.
WHOLE_CHARS = 1 << 18
#: Lags in a range of a longer text at least, and ranges of a text at most: a text is sent once for each of its ranges.
LAGS, RANGES = 1 << 13, 32
#: Lags below the root of the number of words, and below this, are compared whole.
DIRECT = 256


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    get = known.setdefault
    return np.fromiter((get(w, len(known)) for w in words), np.int32, len(words))


@lru_cache(maxsize=4096)
def primes_of(q: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return tuple([*out, q] if q > 1 else out)


def stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of true stretches of at least `least`."""
    if not same.any():
        return []
    turns = np.flatnonzero(np.diff(same.view(np.int8), prepend=0, append=0))
    a, b = turns[::2], turns[1::2]
    long = b - a >= least
    return list(zip(a[long].tolist(), b[long].tolist(), strict=True))


def smallest(ids: np.ndarray, a: int, b: int, q: int) -> bool:
    """Whether no smaller period holds in words a to b, of which q is a period and which are 2q at least: such a one divides q."""
    return not any((ids[a : b - q // r] == ids[a + q // r : b]).all() for r in primes_of(q))


def find_runs(ids: np.ndarray, first: int = 1, last: int | None = None, min_exp: int = MIN_EXP, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs whose period is from first to last, in order of period and start. min_exp is 2 at least.

    A run is a stretch of words with smallest period q, of at least min_words and min_exp * q words, that can't be extended.
    """
    n = len(ids)
    top = n // min_exp if last is None else min(last, n // min_exp)
    if top < 1 or n < min_words or top < first:
        return []
    out = []
    direct = min(DIRECT, max(1, int(n**0.5)))
    for q in range(1, min(direct, n // min_exp) + 1):
        same = ids[q:] == ids[:-q]
        out += [(a, b + q - a, q) for a, b in stretches(same, max(min_words - q, (min_exp - 1) * q)) if smallest(ids, a, b + q, q)]
    low = max(first, direct + 1)
    hits = sampled(ids, low, top, min_exp) if low <= top else []
    known = sorted((r for r in out if r[1] > min_exp * low), key=lambda r: -r[1])
    out = [r for r in out if first <= r[2] <= top]
    for q, multiples in hits:
        # Whole blocks inside a run whose period divides q belong to no run of period q.
        inside = np.zeros(len(multiples), bool)
        for a, size, p in known:
            if size <= q * min_exp:
                break
            if q % p == 0:
                inside |= (multiples * q >= a) & ((multiples + min_exp - 1) * q < a + size)
        multiples = multiples[~inside]
        if not len(multiples):
            continue
        cuts = np.flatnonzero(np.r_[True, np.diff(multiples) > 1, True])
        for c, d in zip(cuts[:-1], cuts[1:], strict=True):
            k0, k1 = int(multiples[c]), int(multiples[d - 1])
            a = (k0 - 1) * q + 1 if k0 else 0
            b = min((k1 + min_exp - 1) * q, n - q)
            for s, e in stretches(ids[a:b] == ids[a + q : b + q], max(min_words - q, (min_exp - 1) * q)):
                s, e = s + a, e + a
                left = s > 0 and ids[s - 1] == ids[s - 1 + q]
                right = e + q < n and ids[e] == ids[e + q]
                if not left and not right and smallest(ids, s, e + q, q):
                    out.append((s, e + q - s, q))
    return out


def sampled(ids: np.ndarray, low: int, top: int, min_exp: int) -> list[tuple[int, np.ndarray]]:
    """(lag, multiples k) for lags from low to top where the min_exp words at k, k + 1, ... times the lag are equal."""
    n = len(ids)
    lag, mult = [], []
    row = np.zeros(top - low + 1, np.int32)  # equal neighbours in a row, for each lag, up to the current multiple
    for k in range((n - 1) // low):
        end = min(top, (n - 1) // (k + 1))  # lags whose next multiple is inside the text
        m = end - low + 1
        here = ids[k * low : k * end + 1 : k] if k else np.broadcast_to(ids[0], m)
        same = here == ids[(k + 1) * low : (k + 1) * end + 1 : k + 1]
        row = (row[:m] + 1) * same
        hit = np.flatnonzero(row >= min_exp - 1)
        if len(hit):
            lag.append(hit + low)
            mult.append(np.full(len(hit), k - min_exp + 2, np.int64))
    if not lag:
        return []
    lags, mults = np.concatenate(lag), np.concatenate(mult)
    order = np.lexsort((mults, lags))
    lags, mults = lags[order], mults[order]
    cuts = np.flatnonzero(np.r_[True, np.diff(lags) > 0, True])
    return [(int(lags[a]), mults[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for a, size, q in runs:
        step[a + q] += 1
        step[a + size] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact exponent; of equal ones the first, then that of smallest period."""
    top = None
    for r in runs:
        if top is None or (r[1] * top[2], -r[0], -r[2]) > (top[1] * r[2], -top[0], -top[2]):
            top = r
    return top


def periodic_runs(docs: DataFrame, finish, out_schema: str, prepare=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """finish(id, words, runs) -> tuple for each row, where runs are (start, length, period) in order of start, then period.

    Words are stretches of other bytes than ASCII white space. prepare(id, words) -> words may change them first; it must depend on nothing else. A null
    text has no words; null and repeated ids each keep their row. Only id_col and text_col are read.
    """
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    long_text = F.length("text") > WHOLE_CHARS
    spark, kind = docs.sparkSession, rows.dtypes[0][1]
    types = [pa.int64()]  # set by finish_rows

    def change(key, text):
        words = words_of(text)
        return prepare(key, words) if prepare else words

    def finish_rows(items):
        found = [finish(*x) for x in items]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, (_, t) in enumerate(types)], [name for name, _ in types])

    def whole(batches):
        for batch in slices(batches):
            types[:] = finish.types(batch.schema.field(0).type)
            items = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = change(key, text)
                items.append((key, words, sorted(find_runs(word_ids(words)))))
            yield finish_rows(items)

    done = rows.where(~long_text).mapInArrow(whole, out_schema)
    longer = materialize(rows.where(long_text).withColumn("no", F.monotonically_increasing_id()), "runs-long", batch_rows=16)
    if longer.isEmpty():
        return done

    def ranges(chars):
        """Lag ranges of a text by its length: it has a word for each two characters at most."""
        lags = F.floor((chars + 1) / (2 * MIN_EXP))
        step = F.greatest(F.lit(LAGS), F.ceil(lags / RANGES))
        return F.transform(F.sequence(F.lit(0), F.floor((lags - 1) / step)), lambda k: F.struct((k * step + 1).alias("first"), ((k + 1) * step).alias("last")))

    n = partitions(spark)
    pieces = longer.select("no", "id", F.explode(ranges(F.length("text"))).alias("r"), "text").repartition(n, "no", "r.first")

    def scan(batches):
        for batch in slices(batches, 1):
            no, key, r, text = (batch.column(k)[0].as_py() for k in range(4))
            runs = find_runs(word_ids(change(key, text)), r["first"], r["last"])
            if runs:
                start, length, period = (pa.array(x, pa.int64()) for x in zip(*runs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([no] * len(runs), pa.int64()), start, length, period], ["no", "start", "length", "period"])

    found = materialize(pieces.mapInArrow(scan, "no long, start long, length long, period long"), "runs-found")
    by_text = found.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    held = longer.join(by_text, "no", "left").select("id", "text", "runs")

    def rest(batches):
        for batch in slices(batches, 1):
            types[:] = finish.types(batch.schema.field(0).type)
            key, text, runs = (batch.column(k)[0].as_py() for k in range(3))
            yield finish_rows([(key, change(key, text), [(r["start"], r["length"], r["period"]) for r in runs or []])])

    assert held.dtypes[0][1] == kind
    return done.unionByName(held.mapInArrow(rest, out_schema))


class RunReport:
    """Finisher of the query: the number of runs, the one of greatest exponent, digests of all runs and of the words that are left."""

    def types(self, id_type):
        longs = [(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
        return [("doc_id", id_type), *longs, ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]

    def __call__(self, key, words, runs):
        runs = sorted(runs, key=lambda r: (r[0], r[2]))
        top = best(runs) or (None, None, None)
        listed = "".join(f"{a},{size},{q}\n" for a, size, q in runs).encode()
        milli = 1000 * top[1] // top[2] if runs else None
        return key, len(runs), *top, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


def plant_runs(key, words: list[bytes]) -> list[bytes]:
    """Every tenth id by its CRC-32 has its words repeat from a place on, by the rule of the query; rows with a null id are as they are."""
    if key is None or not words:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = dict(docs.dtypes)["doc_id"]
    return periodic_runs(docs, RunReport(), f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", plant_runs)


#: Lags at whose multiples four words are equal, then all true stretches of these lags; a stretch inside one whose lag divides its own is no run.
ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT *, len(w) AS n, xor(list_reduce(list_transform(regexp_extract_all(regexp_replace(hex(encode(doc_id::VARCHAR)), '(.)(.)', '\\2\\1', 'g'), '.'), lambda x: ('0x' || x)::BIGINT),
  lambda c, x: xor(c >> 4, {crc_steps()}[(xor(c, x) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM t),
g AS (SELECT *, coalesce(h % 10 = 0 AND n > 0, false) AS planted, CASE WHEN n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS m FROM c),
d AS (SELECT r, doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // m) END]) ELSE w END AS w FROM g),
lag AS (SELECT r, n, w, unnest(range(1, n // 4 + 1)) AS q FROM d),
near AS (SELECT r, n, w, q FROM lag WHERE n >= 6 AND len(list_filter(range(0, (n - 1) // q - 2), lambda k: w[k*q+1] = w[k*q+q+1] AND w[k*q+1] = w[k*q+2*q+1] AND w[k*q+1] = w[k*q+3*q+1])) > 0),
place AS (SELECT r, n, w, q, unnest(range(0, n - q)) AS i FROM near),
same AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM place WHERE w[i + 1] = w[i + q + 1]),
st AS (SELECT r, q, min(i) AS s, count(*) + q AS size FROM same GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM st b WHERE b.r = st.r AND b.q < st.q AND st.q % b.q = 0 AND b.s <= st.s AND b.s + b.size >= st.s + st.size)),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY r),
top AS (SELECT * FROM run WHERE NOT EXISTS (SELECT 1 FROM run b WHERE b.r = run.r AND (b.size * run.q > run.size * b.q OR b.size * run.q = run.size * b.q AND (b.s, b.q) < (run.s, run.q)))),
gone AS (SELECT r, list_distinct(flatten(list(range(s + q, s + size)))) AS g FROM run GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, size AS length, q AS period, 1000 * size // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(range(0, n), lambda i: NOT list_contains(g, i)), lambda i: w[i + 1]) END, ' '), '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (r) LEFT JOIN top USING (r) LEFT JOIN gone USING (r)
"""
