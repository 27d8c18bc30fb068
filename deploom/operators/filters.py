"""Origin, state and catalog filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deploom.functions import ids as I
from deploom.functions.glob import to_regex
from deploom.functions.storage import BROADCAST_BYTES, small, written

from .selector import induced_edges, state_ids

FOREIGN = ("standard", "third-party")


def _hidden(include_standard: bool, include_third_party: bool) -> list[str]:
    return [o for o, keep in zip(FOREIGN, (include_standard, include_third_party), strict=True) if not keep]


def _without(nodes: DataFrame, bad: DataFrame) -> DataFrame:
    """nodes but for the bad ones and all below them. Only bad ids with no bad one above count; each of their depths is a look-up of the prefix of that many
    segments, or all prefixes are looked up at once if depths are many."""
    up = bad.select("id", F.explode(I.ancestors(F.col("id"))).alias("above"))
    covered = up.join(small(bad.select(F.col("id").alias("above")), 40), "above", "left_semi").select("id")
    tops = written(bad.join(covered, "id", "left_anti").select(F.col("id").alias("above"), I.depth(F.col("id")).alias("d")))
    depths = I.depths(tops, "above")
    if depths is None:
        up = nodes.select("id", F.explode(I.ancestors(F.col("id"), True)).alias("above"))
        return nodes.join(written(up.join(tops, "above", "left_semi").select("id").distinct()), "id", "left_anti")
    n = tops.count()
    for d in depths:
        at = tops.where(F.col("d") == d).select("above")
        nodes = nodes.join(F.broadcast(at) if n * 40 <= BROADCAST_BYTES else at, I.prefix(F.col("id"), F.lit(d)) == F.col("above"), "left_anti")
    return nodes


def origin_tree(nodes: DataFrame, edges: DataFrame, include_standard: bool = False, include_third_party: bool = False) -> tuple[DataFrame, DataFrame]:
    """Prunes nodes of hidden origins with everything below them, and edges that lose an end."""
    hidden = _hidden(include_standard, include_third_party)
    if not hidden:
        return nodes, edges
    kept = _without(nodes, written(nodes.where(F.col("origin").isin(hidden)).select("id")))
    return kept, induced_edges(edges, kept.select("id"))


def origin_flat(nodes: DataFrame, include_standard: bool = False, include_third_party: bool = False) -> DataFrame:
    """Drops nodes by their own origin alone; a null origin counts as local, also below a dropped node."""
    return nodes.where(~F.coalesce(F.col("origin"), F.lit("local")).isin(_hidden(include_standard, include_third_party)))


def state_filter(nodes: DataFrame, edges: DataFrame, states: list[str]) -> tuple[DataFrame, DataFrame]:
    ids = written(state_ids(nodes, states))
    return nodes.join(ids, "id", "left_semi"), induced_edges(edges, ids)


def catalog(
    nodes: DataFrame, patterns: list[str] | None = None, include_standard: bool = False, include_third_party: bool = False,
    no_assignments: bool = False, states: list[str] | None = None,
) -> DataFrame:
    """The flat list of nodes: own origin, type, globs over id or name (any of them), own state."""
    out = origin_flat(nodes, include_standard, include_third_party)
    if no_assignments:
        out = out.where("object_type is null or object_type <> 'assignment'")
    if patterns:
        name = F.col("name") if "name" in nodes.columns else F.col("id")
        hit = F.lit(False)
        for p in patterns:
            hit |= F.rlike("id", F.lit(to_regex(p))) | F.rlike(name, F.lit(to_regex(p)))
        out = out.where(hit)
    if states:
        out = out.where(F.col("change_status").isin(states))
    return out


def api_catalog(nodes: DataFrame, edges: DataFrame, include_standard: bool = True, include_third_party: bool = True, states: list[str] | None = None) -> DataFrame:
    """State first, then pruning of origins with their subtrees."""
    if states:
        nodes, edges = state_filter(nodes, edges, states)
    return origin_tree(nodes, edges, include_standard, include_third_party)[0]


def flatten(nodes: DataFrame) -> DataFrame:
    """The columns of a listing, object_type named type."""
    wanted = {"id": "id", "name": "name", "object_type": "type", "origin": "origin", "parent": "parent", "file_path": "file_path", "line": "line", "change_status": "change_status"}
    return nodes.select(*[F.col(c).alias(a) for c, a in wanted.items() if c in nodes.columns])


def strip_flow(nodes: DataFrame) -> DataFrame:
    return nodes.drop("cfg", "pdg")
