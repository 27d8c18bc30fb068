"""The graph that the reference tables project to: regions hold nations, these hold customers with orders and suppliers; brands hold parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deploom.functions import ids as I
from deploom.functions.storage import BROADCAST_BYTES, tasks


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.concat(F.lit("r"), "n_regionkey", F.lit(".n"), "n_nationkey").alias("nid"))


def _owned(spark: SparkSession, sf_dir: str, name: str, key: str, nation: str, letter: str) -> DataFrame:
    t, n = _t(spark, sf_dir, name).select(key, nation), _nation(spark, sf_dir)
    return t.join(F.broadcast(n), t[nation] == n["n_nationkey"]).select(key, F.concat("nid", F.lit(f".{letter}"), key).alias("id"))  # 25 nations


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _owned(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c").withColumnRenamed("id", "cid")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", F.concat("cid", F.lit(".o"), "o_orderkey").alias("id"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.concat(F.lit("parts."), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    return _t(spark, sf_dir, "part").select("p_partkey", brand.alias("brand"), F.concat(brand, F.lit(".p"), "p_partkey").alias("id"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(df: DataFrame, kind: str, origin: str | None) -> DataFrame:
        return df.select("id", F.lit(kind).alias("object_type"), F.lit(origin).cast("string").alias("origin"))

    region = _t(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    parts = _parts(spark, sf_dir)
    return (
        rows(region, "module", "local")
        .unionByName(rows(_nation(spark, sf_dir).withColumnRenamed("nid", "id"), "module", None))
        .unionByName(rows(_owned(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c"), "class", None))
        .unionByName(rows(_owned(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s"), "class", None))
        .unionByName(rows(_orders(spark, sf_dir), "function", None))
        .unionByName(rows(spark.range(1).select(F.lit("parts").alias("id")), "module", "third-party"))
        .unionByName(rows(parts.select(F.col("brand").alias("id")).distinct(), "module", None))
        .unionByName(rows(parts, "assignment", "third-party"))
    )


def _few(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, which has a row of a key and a short id for each row of the table, with a broadcast hint if that is small."""
    return F.broadcast(df) if table.count() * 40 <= BROADCAST_BYTES else df


def dealt(spark: SparkSession, sf_dir: str, each: int = 1) -> int:
    """The number of tasks for `each` rows a line item, or for a row of any other table that line items are joined with."""
    return tasks(spark, each * max(_t(spark, sf_dir, name).count() for name in ("lineitem", "orders", "part")))


def edges(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """Line items go over the network twice, by order and by part, as bare keys; repeats go where the join needs the rows anyway, or stay for a caller that
    drops them itself.

    calls and imports need the same columns of the join with the orders, so that both take one shuffle. Orders and parts are unique keys dealt by their
    number, so a task holds its share in a hash map and sorts nothing.
    """
    line, n = _t(spark, sf_dir, "lineitem"), dealt(spark, sf_dir)
    once = (lambda df: df) if repeats else DataFrame.distinct
    sup = _few(_owned(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s").withColumnRenamed("id", "sid"), _t(spark, sf_dir, "supplier"))
    cust = _owned(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c").withColumnRenamed("id", "cid")
    order = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "cid")
    by_order = line.select("l_orderkey", "l_suppkey").repartition(n, "l_orderkey")
    to_supplier = lambda df: df.join(order.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    calls = to_supplier(once(by_order)).select(F.concat("cid", F.lit(".o"), "o_orderkey").alias("oid"), "sid")
    nation = lambda c: I.prefix(F.col(c), F.lit(2))
    between = to_supplier(by_order).select(nation("cid").alias("aid"), nation("sid").alias("bid"))
    part = _parts(spark, sf_dir).select("p_partkey", F.col("id").alias("pid"))
    made = once(line.select("l_suppkey", "l_partkey").repartition(n, "l_partkey")).join(part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    has = made.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    pair = lambda df, x, y, t: df.select(F.col(x).alias("caller"), F.col(y).alias("callee"), F.lit(t).alias("type"))
    return pair(calls, "oid", "sid", "calls").unionByName(pair(has, "sid", "pid", "has-a")).unionByName(pair(between.where("aid <> bid").distinct(), "aid", "bid", "imports"))


#: The same relations for DuckDB, as the head of a WITH list.
SQL = """
nat AS (SELECT n_nationkey AS k, 'r' || n_regionkey || '.n' || n_nationkey AS id FROM nation),
cus AS (SELECT c_custkey AS k, nat.id || '.c' || c_custkey AS id, nat.id AS nid FROM customer JOIN nat ON c_nationkey = nat.k),
sup AS (SELECT s_suppkey AS k, nat.id || '.s' || s_suppkey AS id, nat.id AS nid FROM supplier JOIN nat ON s_nationkey = nat.k),
ord AS (SELECT o_orderkey AS k, cus.id || '.o' || o_orderkey AS id, cus.nid FROM orders JOIN cus ON o_custkey = cus.k),
par AS (SELECT p_partkey AS k, 'parts.' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS brand FROM part),
nodes AS (SELECT 'r' || r_regionkey AS id, 'module' AS object_type, 'local' AS origin FROM region
  UNION ALL SELECT id, 'module', NULL FROM nat UNION ALL SELECT id, 'class', NULL FROM cus UNION ALL SELECT id, 'class', NULL FROM sup
  UNION ALL SELECT id, 'function', NULL FROM ord UNION ALL SELECT 'parts', 'module', 'third-party'
  UNION ALL SELECT DISTINCT brand, 'module', NULL FROM par UNION ALL SELECT brand || '.p' || k, 'assignment', 'third-party' FROM par),
edges AS (SELECT DISTINCT ord.id AS caller, sup.id AS callee, 'calls' AS type FROM lineitem JOIN ord ON l_orderkey = ord.k JOIN sup ON l_suppkey = sup.k
  UNION ALL SELECT DISTINCT sup.id, par.brand || '.p' || par.k, 'has-a' FROM lineitem JOIN sup ON l_suppkey = sup.k JOIN par ON l_partkey = par.k
  UNION ALL SELECT DISTINCT ord.nid, sup.nid, 'imports' FROM lineitem JOIN ord ON l_orderkey = ord.k JOIN sup ON l_suppkey = sup.k WHERE ord.nid <> sup.nid)
"""
