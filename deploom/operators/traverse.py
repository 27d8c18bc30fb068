"""Traversal of edges and of the hierarchy that dotted ids make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deploom.functions import ids as I
from deploom.functions.storage import remove_written, small, tasks, written

#: Frontiers that a traversal keeps apart before it writes what it has seen as one table.
FRONTIERS = 8


def reach(seeds: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """Distinct ids within `hops` edges (None: any number) of the seeds, seeds included, following caller to callee.

    Each hop joins the new ids with the edges and leaves out those seen; a written frontier keeps plans short and is broadcast only
    while it is small. A larger one is dealt by its number, so that a task holds its share in a hash map and edges, which may be repeated, are not sorted. Null ids and edges
    with a null end are passed over; cycles end as nothing new is found.
    """
    edges = edges.select("caller", "callee").where("caller is not null and callee is not null")
    frontier = written(seeds.select("id").where("id is not null").distinct())
    seen = frontier
    step = 0
    while (hops is None or step < hops) and not frontier.isEmpty():
        near = small(frontier, 40)
        if near is frontier:
            near = frontier.repartition(tasks(frontier.sparkSession, frontier.count()), "id").hint("shuffle_hash")
        found = edges.join(near, edges["caller"] == F.col("id"), "left_semi").select(F.col("callee").alias("id")).distinct()
        frontier = written(found.join(seen, "id", "left_anti"))
        seen = seen.unionByName(frontier)
        step += 1
        if step % FRONTIERS == 0:
            seen = written(seen)
    return seen


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))


def component(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids weakly connected to the seeds."""
    pairs = edges.select("caller", "callee")
    return reach(seeds, pairs.unionByName(reversed_edges(edges)))


def numbered(ids: DataFrame) -> DataFrame:
    """(id, n) of the distinct ids that are not null, written, so that a number stays with its id."""
    return written(ids.select("id").where("id is not null").distinct().withColumn("n", F.monotonically_increasing_id()))


def links_of(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b), written: the numbers of both ends of edges that have them."""
    a, b = known.select(F.col("id").alias("caller"), F.col("n").alias("a")), known.select(F.col("id").alias("callee"), F.col("n").alias("b"))
    return written(edges.select("caller", "callee").where("caller <> callee").join(a, "caller").select("a", "callee").join(b, "callee").select("a", "b"))


def roots(links: DataFrame) -> DataFrame:
    """(n, root) for every end of links (a, b: long), root being one number for each component. links are written; they are removed.

    Each round every number that still has links points to its smallest neighbour, pointers are followed twice, and links are drawn between what they
    point to; links inside a tree go, so that rounds shrink fast.
    """
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        low = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("low"))
        to = written(low.select(F.col("a").alias("n"), F.least("a", "low").alias("to")))
        for _ in range(2):
            ends, before = small(to, 40).select(F.col("n").alias("m"), F.col("to").alias("end")), to
            to = written(to.join(ends, to["to"] == ends["m"]).select("n", F.col("end").alias("to")))
            remove_written(before)
        known, before = small(to, 40), links
        a, b = known.toDF("a", "x"), known.toDF("b", "y")
        links = written(links.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        remove_written(before)
        rounds.append(to)
    if not rounds:
        return links.select(F.col("a").alias("n"), F.col("b").alias("root"))
    out = rounds[0].select("n", F.col("to").alias("root"))
    for to in rounds[1:]:
        later = small(to, 40).select(F.col("n").alias("m"), "to")
        out = out.join(later, F.col("root") == F.col("m"), "left").select("n", F.coalesce("to", "root").alias("root"))
    return out


def all_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for every node, component being the smallest id reachable over edges between nodes.

    Ids are numbered first, so that rounds move numbers; edges are read once. Nodes take their labels from written tables with one row a component,
    which leaves Spark free to split a component that holds most of them. A null id is alone.
    """
    known = numbered(nodes)
    rooted = written(known.join(roots(links_of(edges, known)), "n", "left").select("id", F.coalesce("root", "n").alias("root")))
    names = small(written(rooted.groupBy("root").agg(F.min("id").alias("component"))), 64)
    alone = nodes.select("id").where("id is null").distinct().select("id", F.col("id").alias("component"))
    return rooted.join(names, "root").select("id", "component").unionByName(alone)


def ancestors_of(chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct strict ancestors of the chosen ids that are nodes."""
    up = chosen.select(F.explode(I.ancestors(F.col("id"))).alias("id")).distinct()
    return up.join(nodes.select("id"), "id", "left_semi")


def descendants_of(chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct strict descendants of the chosen ids: every node looks itself up by its prefixes, an equi-join."""
    up = nodes.select("id", F.explode(I.ancestors(F.col("id"))).alias("above"))
    keys = chosen.select(F.col("id").alias("above")).distinct()
    return up.join(keys, "above", "left_semi").select("id").distinct()


def context_closure(chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """The chosen ids, their ancestors, and their descendants but for those below an ancestor that was only added on the way up.

    Only nodes that are neither chosen nor such an ancestor look themselves up by their prefixes.
    """
    chosen = small(written(chosen.select("id").distinct()), 40)
    above = small(written(ancestors_of(chosen, nodes).join(chosen, "id", "left_anti")), 40)
    marks = chosen.select("id", F.lit(True).alias("own")).unionByName(above.select("id", F.lit(False).alias("own"))).withColumnRenamed("id", "above")
    rest = nodes.select("id").join(chosen, "id", "left_anti").join(above, "id", "left_anti")
    up = rest.select("id", F.explode(I.ancestors(F.col("id"))).alias("above"))
    met = up.join(marks, "above").groupBy("id").agg(F.max(F.when(F.col("own"), I.depth(F.col("above")))).alias("s"), F.max(F.when(~F.col("own"), I.depth(F.col("above")))).alias("a"))
    below = met.where("s is not null and (a is null or a < s)").select("id")
    return chosen.unionByName(above).unionByName(below)
