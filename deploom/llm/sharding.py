"""Jump consistent hashing (Lamping and Veach, 2014) in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: The multiplier of the published generator, as two halves of 32 bits; the low half less 2**32, so that products fit a signed long.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
MASK = 0xFFFFFFFF
#: Rows that one numbering task gets at most, about.
ROWS_PER_RUN = 200_000


def digest(column: Column, digits: int) -> Column:
    """The first hex digits of the MD5 of a value's text (null: of no text), as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, digits), 16, 10).cast("long")


def jump_path(key: Column, shards: int) -> Column:
    """struct(now, last): the shards of a 64-bit key with shards + 1 and with shards shards. Jumps rise strictly, so shards + 1 steps suffice.

    The generator's 64-bit product is kept as two non-negative halves, as ANSI arithmetic raises on overflow.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(MASK)).alias("lo"),
        zero.alias("at"), zero.alias("now"), zero.alias("last"),
    )

    def step(s: Column, _: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        p0, p1 = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(LOW), F.shiftright(lo, 16) * F.lit(LOW)
        low = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
        high = (F.shiftright(low, 32) + F.shiftright(p1, 16) + (lo * F.lit(HIGH)).bitwiseAND(F.lit(MASK)) + (hi * F.lit(LOW - (1 << 32))).bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK))
        drawn = F.struct(
            high.alias("hi"), low.bitwiseAND(F.lit(MASK)).alias("lo"),
            s["at"].alias("at"), s["now"].alias("now"), s["last"].alias("last"),
        )

        def jump(d: Column) -> Column:
            to = F.floor((d["at"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(d["hi"], 1) + F.lit(1)).cast("double"))).cast("long")

            def land(t: Column) -> Column:
                return F.struct(
                    d["hi"].alias("hi"), d["lo"].alias("lo"), t.alias("at"),
                    F.when(t <= F.lit(shards), t).otherwise(d["now"]).alias("now"),
                    F.when(t < F.lit(shards), t).otherwise(d["last"]).alias("last"),
                )

            return F.transform(F.array(to), land)[0]

        return F.when(s["at"] > F.lit(shards), s).otherwise(F.transform(F.array(drawn), jump)[0])

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step)


def shard_rows(df: DataFrame, key: str, shards: int) -> DataFrame:
    """df with `shard` and `grown_shard` (with one more shard), both by jump consistent hashing of `key`.

    Nulls: a null key hashes like any other value, so all such rows share a shard. Repeated keys share a shard. Empty tables give
    empty tables. Columns of df named like the outputs are replaced.
    """
    path = jump_path(digest(df[key], 15), shards)
    return df.drop("shard", "grown_shard").withColumn("_jump", path).select(
        *[c for c in df.columns if c not in ("shard", "grown_shard")],
        F.col("_jump.last").cast("int").alias("shard"), F.col("_jump.now").cast("int").alias("grown_shard"),
    )


def number_slots(df: DataFrame, shard: str, order: list[str], total: int) -> DataFrame:
    """df with `slot`, gapless from 0 within each shard.

    A shard may hold any number of rows, so each is numbered in runs: a run is a range of hashes, its rows are numbered by a window,
    and the rows before it come from the counts of the runs, which are few. total: rows of df, for the number of runs. Rows that are equal in
    all columns are one row with a count until they have their numbers, so that many copies of one are no long run; maps can't be
    compared, so a df with one is numbered row by row.
    Ties (rows equal in all of `order`) get successive slots in any order. A column named slot is replaced; a null shard has slot null.
    """
    runs = max(16, total // ROWS_PER_RUN)
    # Columns of df travel in a struct, so that none can clash with those made here.
    run = F.pmod(digest(F.concat_ws(",", *[F.coalesce(df[c].cast("string"), F.lit("")) for c in order]), 7), F.lit(runs)).cast("int")
    spread = df.select(F.struct(*[df[c] for c in df.columns if c != "slot"]).alias("row"), df[shard].alias("s"), run.alias("r"))
    if "map<" in df.drop("slot").schema.simpleString():
        spread = spread.withColumn("k", F.lit(1).cast("long"))
    else:
        spread = spread.groupBy("s", "r", "row").agg(F.count("*").alias("k"))
    counts = spread.groupBy("s", "r").agg(F.sum("k").alias("n"))
    before = counts.select("s", "r", F.expr("sum(n) over (partition by s order by r rows between unbounded preceding and current row) - n").alias("before"))
    inside = f"partition by s, r order by {', '.join(f'row.`{c}`' for c in order)} rows between unbounded preceding and current row"
    numbered = spread.withColumn("at", F.expr(f"sum(k) over ({inside})") - F.col("k"))
    first = F.col("before") + F.col("at")
    slots = F.coalesce(F.sequence(first, first + F.col("k") - 1), F.array_repeat(F.lit(None).cast("long"), F.col("k").cast("int")))
    return numbered.join(before, ["s", "r"], "left").select("row", F.explode(slots).alias("slot")).select("row.*", "slot")


def op9_jump_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """documents dealt to `shards` shards under the law `key`: doc_id and the count of shards decide.

    Null text: size 16 and the CRC of no bytes. Null doc_id: all such rows share a shard. Repeated rows: each keeps its own slot.
    """
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", (F.octet_length(text_of(docs)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text_of(docs), "utf-8")).alias("text_crc32"), F.lit("key").alias("law"),
    )
    out = number_slots(shard_rows(rows, "doc_id", shards), "shard", ["doc_id", "text_crc32", "size"], docs.count())
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def crc_steps() -> list[int]:
    """What the four lowest bits of a CRC-32 (its reflected polynomial) add to it when they are shifted out."""
    steps = list(range(16))
    for _ in range(4):
        steps = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in steps]
    return steps


#: The CRC takes a text by half bytes, the low half of each first.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g') AS halves FROM documents),
r AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h,
    xor(list_reduce(list_transform(regexp_extract_all(halves, '.'), lambda x: ('0x' || x)::BIGINT),
      lambda c, x: xor(c >> 4, {crc_steps()}[(xor(c, x) & 15) + 1]), {MASK}::BIGINT), {MASK}::BIGINT) AS text_crc32 FROM d),
k AS (SELECT DISTINCT doc_id, ('0x' || substr(h, 1, 15))::HUGEINT AS x FROM r),
j AS (
  SELECT doc_id, x, 0::BIGINT AS pos, 0::BIGINT AS now, 0::BIGINT AS last FROM k
  UNION ALL
  SELECT doc_id, y, t, CASE WHEN t <= 40 THEN t ELSE now END, CASE WHEN t < 40 THEN t ELSE last END FROM (
    SELECT *, floor((pos + 1)::DOUBLE * (2147483648::DOUBLE / ((y // 8589934592) + 1)::DOUBLE))::BIGINT AS t FROM (
      SELECT *, (((x // 4294967296) * {LOW} % 4294967296 + (x % 4294967296) * {HIGH} % 4294967296) * 4294967296
        + (x % 4294967296) * {LOW} + 1) % 18446744073709551616 AS y FROM j WHERE pos <= 40))),
p AS (SELECT doc_id, max(now)::INTEGER AS grown_shard, max(last)::INTEGER AS shard FROM j GROUP BY doc_id),
n AS (SELECT count(*) AS total FROM r)
SELECT r.doc_id, r.size, r.text_crc32, 'key' AS law, p.shard, p.grown_shard,
  row_number() OVER (PARTITION BY p.shard ORDER BY ('0x' || substr(md5(concat(r.doc_id::VARCHAR, ',', text_crc32, ',', size)), 1, 7))::BIGINT % greatest(16, total // {ROWS_PER_RUN}), r.doc_id, r.text_crc32, r.size) - 1 AS slot
FROM r JOIN p ON r.doc_id IS NOT DISTINCT FROM p.doc_id CROSS JOIN n
"""
