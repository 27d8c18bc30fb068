"""Counts over a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deploom.functions import ids as I

from .filters import origin_flat
from .selector import induced_edges


def summary(nodes: DataFrame, edges: DataFrame, include_standard: bool = False, include_third_party: bool = False) -> DataFrame:
    """(metric, key, n): nodes and edges in all, nodes by type and by origin, after the flat origin filter."""
    kept = origin_flat(nodes, include_standard, include_third_party)
    kind, origin = F.coalesce("object_type", F.lit("unknown")), F.coalesce("origin", F.lit("local"))
    row = lambda df, metric, key: df.select(F.lit(metric).alias("metric"), key.alias("key"), F.col("n").cast("long").alias("n"))
    counted = kept.groupBy(kind.alias("k"), origin.alias("o")).agg(F.count("*").alias("n"))
    total = row(counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "nodes", F.lit("all"))
    by_type = row(counted.groupBy("k").agg(F.sum("n").alias("n")), "type", F.col("k"))
    by_origin = row(counted.groupBy("o").agg(F.sum("n").alias("n")), "origin", F.col("o"))
    links = row(induced_edges(edges, kept.select("id")).agg(F.count("*").alias("n")), "edges", F.lit("all"))
    return total.unionByName(links).unionByName(by_type).unionByName(by_origin)


def metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, n): node_count, edge_count, and a count for each type."""
    one = lambda df, key: df.agg(F.count("*").alias("n")).select(F.lit(key).alias("key"), "n")
    types = nodes.groupBy(F.coalesce("object_type", F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"))
    return one(nodes, "node_count").unionByName(one(edges, "edge_count")).unionByName(types)


def local_modules(nodes: DataFrame, roots_only: bool = False) -> DataFrame:
    """Modules of local (or no) origin; all of them, or only those that are roots."""
    out = nodes.where((F.col("object_type") == "module") & (F.coalesce("origin", F.lit("local")) == "local")).select("id")
    return out.where(I.depth(F.col("id")) == 1) if roots_only else out


def event_counts(events: DataFrame, kind: str = "kind") -> DataFrame:
    """(kind, n) with a row of kind `total`."""
    counted = events.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return counted.unionByName(counted.agg(F.lit("total").alias("kind"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: status, nodes, edges."""
    n, e = nodes.agg(F.count("*").alias("n"), F.lit(0).alias("m")), edges.agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("m"))
    return n.union(e).agg(F.lit("ok").alias("status"), F.max("n").alias("nodes"), F.max("m").alias("edges"))
