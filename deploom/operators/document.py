"""The nested JSON document of a graph, as lines in order that tasks write; no task and no driver holds a subtree.

A walk in pre-order gives each node one line: its object opens, and closes at once unless a child follows; after its last descendant the objects above it close
as well. What a line closes follows from the levels of the node and of the next one, so a sort by range is all that nesting needs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deploom.functions import ids as I
from deploom.functions.storage import remove_written, small, tasks, written

#: Parts of a document, in order.
HEAD, NODES, MIDDLE, EDGES, TAIL = range(5)


def in_order(df: DataFrame, keys: list[str | Column], level: str | None = None, parts: int | None = None) -> DataFrame:
    """df with `place`, from 0 in the order of keys; with level, also the levels of the rows before and after as `level_before` and `level_after`.

    df is counted and should be written. Rows are cut into ranges and written in order, numbered by the tasks that write them. One row a range tells how many
    lie before it and which levels meet at its ends. Only neighbours take another shuffle.
    """
    n = parts or tasks(df.sparkSession, df.count())
    cut = written(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    cut = cut.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    ends = cut.groupBy("part").agg(F.count("*").alias("size"), *([F.min_by(level, "at").alias("first"), F.max_by(level, "at").alias("last")] if level else []))
    w = Window.orderBy("part")  # a row for each range
    sides = [F.lag("last").over(w).alias("left"), F.lead("first").over(w).alias("right")] if level else []
    ends = F.broadcast(ends.select("part", (F.sum("size").over(w) - F.col("size")).alias("earlier"), *sides))
    place = F.col("earlier") + F.col("at")
    if not level:
        return cut.join(ends, "part").withColumn("place", place).drop("part", "at", "earlier")
    inside = Window.partitionBy("part").orderBy("at")
    out = cut.repartition(n, "part").withColumn("level_before", F.lag(level).over(inside)).withColumn("level_after", F.lead(level).over(inside)).join(ends, "part").withColumn("place", place)
    return out.withColumn("level_before", F.coalesce("level_before", "left")).withColumn("level_after", F.coalesce("level_after", "right")).drop("part", "at", "earlier", "left", "right")


def with_levels(nodes: DataFrame) -> DataFrame:
    """nodes with `root_depth`, the segments of the root above each, and `level`, the steps down from it. Roots are ids of one segment, and those whose id
    without its last segment is no node."""
    ids = written(nodes.select("id"))
    above = ids.withColumn("parent", I.parent(F.col("id"))).where("parent is not null")
    loose = written(above.join(ids.select(F.col("id").alias("parent")), "parent", "left_anti").select(F.col("id").alias("above")))
    if loose.isEmpty():
        return nodes.withColumn("root_depth", F.lit(1)).withColumn("level", I.depth(F.col("id")) - 1)
    loose = small(loose, 256)
    under = ids.select("id", F.explode(I.ancestors(F.col("id"), True)).alias("above")).join(loose, "above", "left_semi")
    under = under.groupBy("id").agg(F.max(I.depth(F.col("above"))).alias("deepest"))
    out = nodes.join(under, "id", "left").withColumn("root_depth", F.coalesce("deepest", F.lit(1))).drop("deepest")
    return out.withColumn("level", I.depth(F.col("id")) - F.col("root_depth"))


def node_lines(nodes: DataFrame, all_fields: bool = False, parts: int | None = None) -> DataFrame:
    """(place, id, text) of the distinct non-null ids of nodes: the lines between the brackets of a list of roots, by depth and id; children by id.

    all_fields: null fields are written, and nodes without children have an empty list. Of rows with one id the one with the least text counts. Ids must not
    hold U+0000 or U+0001.
    """
    fields = F.to_json(F.struct(*[c for c in nodes.columns]), {"ignoreNullFields": str(not all_fields).lower()})
    parts = parts or tasks(nodes.sparkSession, nodes.count())
    objects = nodes.where("id is not null").select("id", fields.alias("object")).repartition(parts, "id")  # dealt before they are sorted, and sorted once
    objects = written(objects.groupBy("id").agg(F.min("object").alias("object")))
    rows = in_order(with_levels(objects), ["root_depth", I.prefix(F.col("id"), F.col("root_depth")), F.translate("id", ".", "\x01")], "level", parts)
    opened = F.expr("substring(object, 1, length(object) - 1)")
    deeper = F.coalesce(F.col("level_after") > F.col("level"), F.lit(False))
    up = F.greatest(F.col("level") - F.coalesce("level_after", F.lit(0)), F.lit(0))
    comma = F.when(F.col("level_before") >= F.col("level"), ",").otherwise("")
    leaf = F.concat(opened, F.lit(',"children":[]}')) if all_fields else F.col("object")
    body = F.when(deeper, F.concat(opened, F.lit(',"children":['))).otherwise(leaf)
    return rows.select("place", "id", F.concat(comma, body, F.repeat(F.lit("]}"), up.cast("int"))).alias("text"))


def edge_lines(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(place, text) of the edges by caller, callee and type, repeats included. Bare columns move; texts are made of them in place."""
    rows = in_order(edges.select("caller", "callee", "type"), ["caller", "callee", "type"], None, parts)
    return rows.select("place", F.concat(F.when(F.col("place") > 0, ",").otherwise(""), F.to_json(F.struct("caller", "callee", "type"))).alias("text"))


def _single(spark, section: int, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(section).alias("section"), F.lit(0).cast("long").alias("place"), F.lit(text).alias("text"))


def metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row `text`: the JSON of node_count, edge_count and node_types (counts by object_type, unknown for null), of distinct ids."""
    kind = F.coalesce("object_type", F.lit("unknown")) if "object_type" in nodes.columns else F.lit("unknown")
    kinds = nodes.where("id is not null").groupBy("id").agg(F.min(kind).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))  # a row for each type
    both = kinds.unionByName(edges.agg(F.count("*").alias("n")).withColumn("kind", F.lit(None).cast("string")))
    one = both.agg(
        F.coalesce(F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))), F.lit(0)).alias("node_count"), F.sum(F.when(F.col("kind").isNull(), F.col("n"))).alias("edge_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n"))))).alias("node_types"),
    )
    return one.select(F.to_json(F.struct("node_count", "edge_count", "node_types")).alias("text"))


def document(nodes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(section, place, text): the lines of {"nodes": roots with their children, "edges": [...], "metadata": {...}}, to be read in this order. Null fields are left
    out. Empty frames give empty lists."""
    spark = nodes.sparkSession
    tail = metadata(nodes, edges).select(F.lit(TAIL).alias("section"), F.lit(0).cast("long").alias("place"), F.concat(F.lit('],"metadata":'), "text", F.lit("}")).alias("text"))
    body = node_lines(nodes.drop("parent", "depth"), parts=parts).select(F.lit(NODES).alias("section"), "place", "text")
    links = edge_lines(edges, parts).select(F.lit(EDGES).alias("section"), "place", "text")
    return _single(spark, HEAD, '{"nodes":[').unionByName(body).unionByName(_single(spark, MIDDLE, '],"edges":[')).unionByName(links).unionByName(tail)


def catalog_document(nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """(section, place, text) of the catalog: each node with id, name, label, type, origin (local for null), parent and children; metadata holds the number of all nodes,
    nested ones included. nodes: what filters.api_catalog gives."""
    # A listing of a graph without names shows the last segments.
    name = F.col("name") if "name" in nodes.columns else I.last(F.col("id"))
    label = F.coalesce("label", name) if "label" in nodes.columns else name
    origin = F.coalesce("origin", F.lit("local")) if "origin" in nodes.columns else F.lit("local")
    parent = F.col("parent") if "parent" in nodes.columns else I.parent(F.col("id"))
    kind = F.col("object_type") if "object_type" in nodes.columns else F.lit(None).cast("string")
    shown = nodes.select("id", name.alias("name"), label.alias("label"), kind.alias("type"), origin.alias("origin"), parent.alias("parent"))
    body = written(node_lines(shown, True, parts))
    tail = body.agg(F.count("*").alias("node_count")).select(F.lit(TAIL).alias("section"), F.lit(0).cast("long").alias("place"), F.concat(F.lit('],"metadata":'), F.to_json(F.struct("node_count")), F.lit("}")).alias("text"))
    return _single(nodes.sparkSession, HEAD, '{"nodes":[').unionByName(body.select(F.lit(NODES).alias("section"), "place", "text")).unionByName(tail)


def write_document(lines: DataFrame, path: str) -> None:
    """Writes a document as text files in `path`, which joined by name are the JSON; tasks write them, each a range of lines."""
    lines.sort("section", "place").select("text").write.mode("overwrite").text(path)


def stream(lines: DataFrame) -> Iterator[str]:
    """The lines in order, a partition at a time."""
    ready = written(lines)
    for row in ready.sort("section", "place").select("text").toLocalIterator():
        yield row[0]
    remove_written(ready)
