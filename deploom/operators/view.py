"""Analytics of a partly unfolded graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deploom.functions import ids as I

#: Rank of edge types between one pair; imports come last.
PRIORITY = {"calls": 3, "is-a": 2, "has-a": 1}


def roll_up(edges: DataFrame, max_depth: int) -> DataFrame:
    """Edges with both ends lifted to max_depth segments below what they share; those whose ends meet go."""
    n = I.common_depth(F.col("caller"), F.col("callee")) + F.lit(max_depth)
    lifted = edges.select(I.lift(F.col("caller"), n).alias("caller"), I.lift(F.col("callee"), n).alias("callee"), "type")
    return lifted.where("caller <> callee").distinct()


def to_visible(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges between the nearest visible ancestors (or selves) of their ends; ends without one, or with the same, go."""
    ends = edges.select(F.col("caller").alias("id")).unionByName(edges.select(F.col("callee").alias("id"))).distinct()
    up = ends.select("id", F.explode(I.ancestors(F.col("id"), True)).alias("above")).join(visible.select(F.col("id").alias("above")).distinct(), "above")
    near = up.groupBy("id").agg(F.max_by("above", I.depth(F.col("above"))).alias("shown"))
    a, b = near.toDF("caller", "a"), near.toDF("callee", "b")
    out = edges.join(a, "caller").join(b, "callee").where("a <> b")
    return out.select(F.col("a").alias("caller"), F.col("b").alias("callee"), "type").distinct()


def best_edge(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """One edge for each pair: the type of highest priority, by name among equals.

    Texts that are compared want their rows sorted. parts: the number of tasks that rows are dealt to first, so that they are sorted once, in bounded shares.
    """
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("type")], F.lit(0))
    edges = edges.select("caller", "callee", "type")
    dealt = edges.repartition(parts, "caller", "callee") if parts else edges
    return dealt.groupBy("caller", "callee").agg(F.max(F.struct(rank.alias("rank"), F.col("type"))).alias("best")).select("caller", "callee", "best.type")


def neighbourhood(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(id, highlight) one hop around a node and its descendants: path (both ways) over upstream (what it uses) over downstream; ancestors
    take the strongest mark below them."""
    own = nodes.where((F.col("id") == node) | F.startswith("id", F.lit(node + "."))).select("id")
    up = edges.join(own.withColumnRenamed("id", "caller"), "caller", "left_semi").select(F.col("callee").alias("id"), F.lit(2).alias("m"))
    down = edges.join(own.withColumnRenamed("id", "callee"), "callee", "left_semi").select(F.col("caller").alias("id"), F.lit(1).alias("m"))
    marks = up.unionByName(down).join(own, "id", "left_anti").groupBy("id").agg(F.when(F.count_distinct("m") > 1, 3).otherwise(F.max("m")).alias("m"))
    spread = marks.select(F.explode(I.ancestors(F.col("id"), True)).alias("id"), "m").groupBy("id").agg(F.max("m").alias("m"))
    spread = spread.join(nodes.select("id"), "id", "left_semi")
    return spread.where((F.col("id") != node) & ~F.startswith("id", F.lit(node + ".")) & ~F.startswith(F.lit(node), F.concat("id", F.lit(".")))).select(
        "id", F.element_at(F.array(F.lit("downstream"), F.lit("upstream"), F.lit("path")), F.col("m")).alias("highlight")
    )


def highlighted_edges(edges: DataFrame, marked: DataFrame) -> DataFrame:
    a, b = marked.select(F.col("id").alias("caller")), marked.select(F.col("id").alias("callee"))
    return edges.join(a, "caller", "left_semi").join(b, "callee", "left_semi").select("caller", "callee", "type")


def dependencies(edges: DataFrame, node: str, visible: DataFrame, dependents: bool = False) -> DataFrame:
    """Distinct (target, type) from a node or its descendants to visible nodes; with dependents, the other way round."""
    here, there = ("callee", "caller") if dependents else ("caller", "callee")
    under = (F.col(here) == node) | F.startswith(here, F.lit(node + "."))
    outside = (F.col(there) != node) & ~F.startswith(there, F.lit(node + "."))
    out = edges.where(under & outside).select(F.col(there).alias("target"), "type").distinct()
    return out.join(visible.select(F.col("id").alias("target")), "target", "left_semi").select("target", "type")


def type_ahead(nodes: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Ids that hold the last comma term of a query, without its operators, in any case; in order of id if limited."""
    term = re.sub(r"[@+|*]", "", text.rsplit(",", 1)[-1]).strip().lower()
    out = nodes.where(F.contains(F.lower("id"), F.lit(term))).select("id") if term else nodes.select("id").where("false")
    return out.orderBy("id").limit(limit) if limit else out


def tree_search(nodes: DataFrame, text: str) -> DataFrame:
    """Ids that hold the text, or one of whose segments starts with it, in any case; with their ancestors."""
    term = text.lower()
    hit = nodes.where(F.contains(F.lower("id"), F.lit(term)) | F.exists(I.segments(F.lower("id")), lambda s: F.startswith(s, F.lit(term)))).select("id")
    up = hit.select(F.explode(I.ancestors(F.col("id"), True)).alias("id")).distinct()
    return up.join(nodes.select("id"), "id", "left_semi")


def view_nodes(nodes: DataFrame) -> DataFrame:
    """(id, kind, origin, collapsed, n_children): an unknown type shows as module if it has children, else as function."""
    kids = nodes.select(I.parent(F.col("id")).alias("p")).where("p is not null").groupBy("p").agg(F.count("*").alias("n"))
    out = nodes.join(kids, nodes["id"] == kids["p"], "left")
    known = F.col("object_type").isin("module", "class", "function", "assignment", "interface")
    kind = F.when(known, F.col("object_type")).when(F.col("n") > 0, "module").otherwise("function")
    return out.select("id", kind.alias("kind"), F.coalesce("origin", F.lit("local")).alias("origin"), F.lit(True).alias("collapsed"), F.coalesce("n", F.lit(0)).cast("long").alias("n_children"))


def open_chain(nodes: DataFrame) -> DataFrame:
    """Local modules that stay open: every node from the root to them has one child at most but for the last."""
    kids = nodes.select(I.parent(F.col("id")).alias("p")).where("p is not null").groupBy("p").agg(F.count("*").alias("n"))
    local = nodes.where((F.col("object_type") == "module") & (F.coalesce("origin", F.lit("local")) == "local")).select("id")
    up = local.select("id", F.explode(I.ancestors(F.col("id"))).alias("p")).join(kids, "p", "left")
    wide = up.where("n > 1").select("id").distinct()
    return local.join(wide, "id", "left_anti")


def change_overview(nodes: DataFrame, ghosts: DataFrame) -> DataFrame:
    """(parent, n_changed, n_ghosts) of nodes with a status and of ghosts, by parent id (roots: empty)."""
    name = F.coalesce(I.parent(F.col("id")), F.lit(""))
    a = nodes.where("change_status is not null").select(name.alias("parent"), F.lit(1).alias("c"), F.lit(0).alias("g"))
    b = ghosts.select(name.alias("parent"), F.lit(0).alias("c"), F.lit(1).alias("g"))
    return a.unionByName(b).groupBy("parent").agg(F.sum("c").alias("n_changed"), F.sum("g").alias("n_ghosts"))


def code_matches(nodes: DataFrame, text: str, column: str = "code_block") -> DataFrame:
    """(id, n) non-overlapping occurrences of a text in the code, in any case; ids without any go."""
    low, term = F.lower(column), text.lower()
    n = (F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / F.lit(max(1, len(term)))
    return nodes.select("id", n.cast("long").alias("n")).where("n > 0")


def fallback_origin(nodes: DataFrame, standard: list[str], local_prefix: str = "src") -> DataFrame:
    """(id, origin): where it is missing, ids under local_prefix are local, those under a standard name standard, others third-party."""
    guess = F.when(F.startswith("id", F.lit(local_prefix)), "local").when(I.top(F.col("id")).isin(standard), "standard").otherwise("third-party")
    return nodes.select("id", F.coalesce("origin", guess).alias("origin"))


def prune_stale(saved: DataFrame, nodes: DataFrame) -> DataFrame:
    return saved.join(nodes.select("id"), "id", "left_semi")
