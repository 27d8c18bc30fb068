"""SimHash near-dedup with pigeonring filtering (Qin and Xiao, 2018).

A 64-bit fingerprint is a ring of 8 segments of 8 bits. If two fingerprints differ in at most 3 bits, then some segment starts a chain
whose first l segments differ in at most 3 l / 8 bits, for every l from 1 to 8: none in the first two, at most one in the first five,
two in the first seven. So for each start the first 16 bits are equal, and of the 24 bits after them one half of 12 is equal too: these
28 bits are a bucket's key. Pairs in a bucket must pass the budgets of the whole chain before the full Hamming check.

Equal fingerprints are one class from the beginning. A bucket gives a forest of links (fewer than its members), not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import discard, materialize, small, table, text_of
from .components import components, local_components

SEED = 42
SEGMENTS, BITS = 8, 64
#: Buckets up to this size compare at each distance in the sorted run; larger ones grow components from a frontier.
RUN = 48


def words_fingerprint(words: list[bytes], width: int = 3) -> int:
    """SimHash of the word shingles, repeats included; fewer words: the whole sequence; none: zero."""
    import xxhash

    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        hashes = np.array([digest(b" ".join(words[i : i + width]), SEED) for i in range(at, min(n, at + (1 << 15)))], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): A-Z lower-cased, words are runs of bytes other than ASCII white space."""

    def run(batches):
        for batch in batches:
            out = np.array([words_fingerprint(t.as_py().encode().lower().split()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp long")


def bucket_keys(fp):
    """The 16 bucket keys of a fingerprint: 8 starts, and the two halves of the 24 bits behind the first two segments."""
    keys = []
    for start in range(SEGMENTS):
        turned = fp if start == 0 else F.shiftleft(fp, 8 * start).bitwiseOR(F.shiftrightunsigned(fp, BITS - 8 * start))
        head = F.shiftleft(F.shiftrightunsigned(turned, 48), 12)
        for half in range(2):
            tail = F.shiftrightunsigned(turned, 36 - 12 * half).bitwiseAND(F.lit(0xFFF))
            keys.append(head.bitwiseOR(tail).bitwiseOR(F.lit((start * 2 + half) << 28)))
    return F.array(*keys)


def chain_holds(start: np.ndarray, difference: np.ndarray, limit: int) -> np.ndarray:
    """Whether the chain from `start` keeps its proportional budget at every length."""
    s = (start * np.uint64(8)).astype(np.uint64)
    turned = np.where(s == 0, difference, (difference << s) | (difference >> ((np.uint64(64) - s) & np.uint64(63))))
    ok = np.ones(len(turned), bool)
    for length in range(1, SEGMENTS + 1):
        ok &= np.bitwise_count(turned >> np.uint64(BITS - 8 * length)) <= limit * length // SEGMENTS
    return ok


def grow(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components of one large bucket; points that are reached are not compared again."""
    rest, a, b = values, [], []
    while len(rest):
        root, rest = rest[:1], rest[1:]
        frontier = root
        while len(frontier) and len(rest):
            front, frontier = frontier[:64], frontier[64:]
            near = (np.bitwise_count(front[:, None] ^ rest[None, :]) <= limit).any(axis=0)
            hit, rest = rest[near], rest[~near]
            a.append(hit)
            b.append(np.repeat(root, len(hit)))
            frontier = np.concatenate([frontier, hit])
    return (np.concatenate(a), np.concatenate(b)) if a else (values[:0], values[:0])


def bucket_links(keys: np.ndarray, fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) pairs from whole buckets, rows sorted by key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    size_of = np.repeat(sizes, sizes)
    a, b = [fps[:0]], [fps[:0]]
    at = np.flatnonzero((size_of > 1) & (size_of <= RUN))
    for step in range(1, RUN):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        difference = fps[at] ^ fps[at + step]
        good = chain_holds((keys[at] >> 29).astype(np.uint64), difference, limit)
        good[good] = np.bitwise_count(difference[good]) <= limit
        a.append(fps[at[good]])
        b.append(fps[at[good] + step])
    for k in np.flatnonzero(sizes > RUN):
        x, y = grow(np.unique(fps[starts[k] : starts[k] + sizes[k]]), limit)
        a.append(x)
        b.append(y)
    node, root = local_components(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
    return node[node != root], root[node != root]


def print_links(classes: DataFrame, limit: int = 3) -> DataFrame:
    """(a, b): links between the distinct fingerprints `fp` of classes, by which the components are those of all pairs that differ in at most `limit` bits."""

    def links(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            whole = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last bucket may go on
            if whole:
                a, b = bucket_links(keys[:whole], fps[:whole], limit)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            a, b = bucket_links(keys, fps, limit)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    n = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = classes.select(F.explode(bucket_keys(F.col("fp"))).alias("key"), "fp").repartition(n, "key").sortWithinPartitions("key")
    return keyed.mapInArrow(links, "a long, b long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for each row of docs; texts link if their fingerprints differ in at most `limit` bits.

    limit is 3 or less, as the bucket keys are made for it. Null and empty texts, and texts of white space alone, have fingerprint zero
    and link with each other like any other. Null ids never name a component; one of only null ids has a null component_id. Repeated
    rows each come back. Only id_col and text_col are read. Whole texts are hashed, however long.
    """
    if not 0 <= limit <= 3:
        raise ValueError("limit must be from 0 to 3")
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-classes")
    spark = docs.sparkSession
    roots = components(print_links(classes, limit))
    linked = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = materialize(linked, "simhash-roots")
    # Written, so that the rows of a large component are dealt over several tasks.
    named = materialize(linked.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-named")
    by_print = materialize(linked.join(small(named, 40), "root").select("fp", "component_id"), "simhash-components")
    discard(spark, classes, linked, named)
    return prints.join(small(by_print, 40), "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the smallest id of each component only; columns as they are.

    Rows are told apart by id and fingerprint, so a repeated id takes no other text along. Rows with a null id stay if nothing names their
    component. Rows that repeat the kept id and whose fingerprints are in its component all stay.
    """
    keyed = near_components(docs, id_col, text_col).where(f"component_id is not null and not {id_col} <=> component_id")
    gone = keyed.select(F.col(id_col).alias("id"), F.conv("fingerprint", 16, 10).alias("fp")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))

    def run(batches):
        for batch in batches:
            found = [str(words_fingerprint(t.as_py().encode().lower().split())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["row", "id", "fp"])

    printed = rows.mapInArrow(run, StructType([rows.schema["row"], rows.schema["id"], StructField("fp", StringType())]))
    return printed.join(gone, printed["id"].eqNullSafe(gone["id"]) & (printed["fp"] == gone["fp"]), "left_anti").select("row.*")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


#: Constants of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def oracle() -> str:
    """DuckDB SQL of the query: XXH64 in arithmetic of 128 bits, bits by majority, components by a recursive join of all fingerprints.

    A rotation by r is a product with 2**r modulo 2**64 - 1, which names its argument once; it differs for 2**64 - 1 alone.
    """
    ring = 1 << BITS

    def mul(a: str, p: int) -> str:
        return f"(({a})::UHUGEINT * {p}::UHUGEINT % {ring}::UHUGEINT)"

    def add(a: str, b: str | int) -> str:
        return f"((({a})::UHUGEINT + ({b})::UHUGEINT) % {ring}::UHUGEINT)"

    def turn(a: str, r: int) -> str:
        return f"(({a})::UHUGEINT * {1 << r}::UHUGEINT % {ring - 1}::UHUGEINT)"

    def xor(a: str, b: str) -> str:
        return f"xor(({a})::UBIGINT, ({b})::UBIGINT)"

    def taken_in(state: str, lane: str) -> str:
        return mul(turn(add(state, mul(lane, P2)), 31), P1)

    # r is the hexadecimal text of the bytes from last to first, so that a little-endian number is one piece of it.
    def fold(count: str, at: str, width: int, step: str, start: str | int) -> str:
        lane = f"('0x' || substr(r, (n - ({at}) - {width}) * 2 + 1, {2 * width}))::UBIGINT::UHUGEINT"
        return f"list_reduce(list_transform(generate_series(0, {count} - 1), lambda k: {lane}), lambda a, l: ({step})::UHUGEINT, ({start})::UHUGEINT)"

    starts = [(SEED + P1 + P2) % ring, (SEED + P2) % ring, SEED, (SEED - P1) % ring]
    states = [f"{fold('n // 32', f'k * 32 + {8 * i}', 8, taken_in('a', 'l'), s)} AS v{i + 1}" for i, s in enumerate(starts)]
    long_text = add(add(turn("v1", 1), turn("v2", 7)), add(turn("v3", 12), turn("v4", 18)))
    for i in range(1, 5):
        long_text = add(mul(xor(long_text, taken_in("0", f"v{i}")), P1), P4)
    eights = fold("n % 32 // 8", "n // 32 * 32 + k * 8", 8, add(mul(turn(xor("a", taken_in("0", "l")), 27), P1), P4), "h")
    fours = fold("n % 8 // 4", "n // 8 * 8", 4, add(mul(turn(xor("a", mul("l", P1)), 23), P2), P3), "h")
    ones = fold("n % 4", "n // 4 * 4 + k", 1, mul(turn(xor("a", mul("l", P5)), 11), P1), "h")
    bits = " + ".join(f"CASE WHEN 2 * sum(h >> {k} & 1) > count(*) THEN {1 << k}::UHUGEINT ELSE 0 END" for k in range(BITS))
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(generate_series(1, greatest(1, len(w) - 2)), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM t WHERE len(w) > 0),
d AS (SELECT s, octet_length(encode(s)) AS n, array_to_string(list_reverse(regexp_extract_all(hex(encode(s)), '..')), '') AS r FROM (SELECT DISTINCT s FROM s)),
x0 AS (SELECT *, {", ".join(states)} FROM d),
x1 AS (SELECT s, n, r, {add(f"CASE WHEN n < 32 THEN {SEED + P5}::UHUGEINT ELSE {long_text} END", "n")} AS h FROM x0),
x2 AS (SELECT s, n, r, {eights} AS h FROM x1),
x3 AS (SELECT s, n, r, {fours} AS h FROM x2),
x4 AS (SELECT s, ({ones})::UBIGINT AS h FROM x3),
x5 AS (SELECT s, {mul("xor(h, h >> 33)", P2)}::UBIGINT AS h FROM x4),
x6 AS (SELECT s, {mul("xor(h, h >> 29)", P3)}::UBIGINT AS h FROM x5),
x7 AS (SELECT s, xor(h, h >> 32) AS h FROM x6),
b AS (SELECT doc_id, {bits} AS f FROM s JOIN x7 USING (s) GROUP BY doc_id),
f AS (SELECT t.doc_id, coalesce(b.f, 0)::UBIGINT AS f FROM t LEFT JOIN b ON t.doc_id = b.doc_id),
u AS (SELECT f, min(doc_id) AS least FROM f GROUP BY f),
e AS (SELECT x.f AS a, y.f AS b FROM u x JOIN u y ON bit_count(xor(x.f, y.f)::BIT) <= 3),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
g AS (SELECT c.a AS f, min(u.least) AS component_id FROM c JOIN u ON c.b = u.f GROUP BY c.a)
SELECT f.doc_id, lpad(lower(to_hex(f.f)), 16, '0') AS fingerprint, g.component_id FROM f JOIN g ON f.f = g.f
"""


ORACLE = oracle()
