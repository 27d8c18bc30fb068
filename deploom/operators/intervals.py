"""Pre-order numbers of dotted ids: a subtree is a range of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deploom.functions.storage import written

#: Numbers in a block, by which ranges meet the nodes that lie in them.
BLOCK = 4096


def number(nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, pre, end) of the distinct ids: their place in pre-order, siblings by name, and that of the last id below them (or their own).

    Every id is sorted twice, as itself and as a mark that follows all that lies below it; both count the ids before them. Ids are cut into ranges by key; a
    range counts its own, and the counts of ranges, one row each, are summed up in order. An id needs no ancestors among the nodes. Ids must not hold
    the characters U+0001 and U+0002.
    """
    n = parts or int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.translate("id", ".", "\x01")  # below all other characters, so that a subtree lies together
    ids = nodes.select("id").where("id is not null").distinct()
    marks = ids.select("id", key.alias("key"), F.lit(1).alias("own")).unionByName(ids.select("id", F.concat(key, F.lit("\x02")).alias("key"), F.lit(0).alias("own")))
    cut = written(marks.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()))
    sizes = cut.groupBy("part").agg(F.sum("own").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # a row for each range
    inside = F.sum("own").over(Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    counted = cut.withColumn("inside", inside).join(F.broadcast(before), "part").select("id", "own", (F.col("before") + F.col("inside") - 1).alias("at"))
    return counted.groupBy("id").agg(F.max(F.when(F.col("own") == 1, F.col("at"))).alias("pre"), F.max(F.when(F.col("own") == 0, F.col("at"))).alias("end"))


def below(numbered: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of numbered (id, pre, end, ...) that lie strictly below any of the chosen ids, by ranges of numbers: a range meets the blocks that it spans."""
    spans = numbered.join(chosen.select("id").distinct(), "id", "left_semi").where("end > pre").select((F.col("pre") + 1).alias("low"), F.col("end").alias("high"))
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK))))
    # Within a block only what each range covers of it matters, and ranges nest: one row for each distinct piece.
    pieces = spans.select("block", F.greatest("low", F.col("block") * BLOCK).alias("low"), F.least("high", (F.col("block") + 1) * BLOCK - 1).alias("high")).distinct()
    rows = numbered.withColumn("block", F.floor(F.col("pre") / BLOCK))
    return rows.join(pieces, (rows["block"] == pieces["block"]) & (rows["pre"] >= pieces["low"]) & (rows["pre"] <= pieces["high"]), "left_semi").drop("block")


def prune(numbered: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of numbered that are neither bad nor below a bad one."""
    gone = below(numbered, bad).select("id").unionByName(bad.select("id"))
    return numbered.join(gone, "id", "left_anti")


def sizes(numbered: DataFrame) -> DataFrame:
    """(id, n_below): how many ids lie below each, at any depth."""
    return numbered.select("id", (F.col("end") - F.col("pre")).alias("n_below"))


def listing(nodes: DataFrame, flat: DataFrame) -> DataFrame:
    """flat, which has `id`, with its number in pre-order as `place`, the order that a walk of the tree gives."""
    return flat.join(number(nodes).select("id", F.col("pre").alias("place")), "id")
