"""Change tracking between two snapshots of a graph, and coalescing of file events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deploom.functions import ids as I
from deploom.functions.storage import written


def coalesce_events(events: DataFrame, key: str, kind: str, seq: str) -> DataFrame:
    """(key, kind) of the last event of each key, but `created` if any event created it."""
    created = F.bool_or(F.col(kind) == "created")
    return events.groupBy(key).agg(F.when(created, "created").otherwise(F.max_by(kind, seq)).alias(kind))


def sessions(events: DataFrame, key: str | None, ts: str, gap: str) -> DataFrame:
    """(key, first, last, n) of runs of events less than `gap` apart. With a watermark on events this streams as it is."""
    groups = [F.session_window(ts, gap).alias("w")] + ([F.col(key)] if key else [])
    out = events.groupBy(*groups).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))
    return out.select(*([key] if key else []), "first", "last", "n")


def global_sessions(events: DataFrame, ts: str, gap: str, parts: int | None = None) -> DataFrame:
    """(first, last, n) of runs of events less than `gap` apart, of all events as one sequence, with no task that has them all.

    Equal times become one row with a count first. Times are cut into ranges, runs are found within each range, and only the first and the last run of
    a range can belong together with one of another: these, at most two rows a range, are joined in order. A run may span any number
    of ranges. Rows with a null time go.
    """
    n = parts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    times = events.where(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("t")).agg(F.count("*").alias("n"))
    cut = written(times.repartitionByRange(n, "t").withColumn("part", F.spark_partition_id()))
    step = F.expr(f"interval {gap}")

    def runs_by(df: DataFrame, first: str, last: str, w) -> DataFrame:
        new = F.coalesce(F.col(first) >= F.lag(last).over(w) + step, F.lit(True))
        return df.withColumn("_new", new.cast("long")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    span = [F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")]
    inside = runs_by(cut.select("part", F.col("t").alias("first"), F.col("t").alias("last"), "n"), "first", "last", Window.partitionBy("part").orderBy("first"))
    local = written(inside.groupBy("part", "run").agg(*span))
    ends = local.groupBy("part").agg(F.max("run").alias("top"))
    local = written(local.join(ends, "part").select("first", "last", "n", ((F.col("run") == 1) | (F.col("run") == F.col("top"))).alias("border")))
    border = runs_by(local.where("border"), "first", "last", Window.orderBy("first"))  # two rows a range at most
    return local.where("not border").select("first", "last", "n").unionByName(border.groupBy("run").agg(*span).drop("run"))


def flatten_origin(nodes: DataFrame) -> DataFrame:
    """(id, origin): the own origin or that of the nearest ancestor that has one."""
    up = nodes.select("id", F.explode(I.ancestors(F.col("id"), True)).alias("above"))
    known = nodes.where("origin is not null").select(F.col("id").alias("above"), "origin")
    near = up.join(known, "above").groupBy("id").agg(F.max_by("origin", I.depth(F.col("above"))).alias("origin"))
    return nodes.select("id").join(near, "id", "left")


def node_diff(old: DataFrame, new: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(id, status, is_ghost) after a new snapshot. old, new: (id, hash) of local nodes; prior: (id, status, is_ghost, hash) or none.

    In this order: a ghost that is back is clear if its hash is the ghost's, else modified; a new id without status is added; an id that
    is gone is deleted and becomes a ghost; an id whose hash differs is modified unless it is added or deleted. Statuses stay until they
    are dismissed; clear ids have none.
    """
    if prior is None:
        prior = old.select("id", F.lit(None).cast("string").alias("status"), F.lit(False).alias("is_ghost"), F.lit(None).cast("string").alias("hash")).where("false")
    o = old.select("id", F.col("hash").alias("oh"), F.lit(True).alias("in_old"))
    n = new.select("id", F.col("hash").alias("nh"), F.lit(True).alias("in_new"))
    p = prior.select("id", F.col("status").alias("ps"), F.coalesce("is_ghost", F.lit(False)).alias("pg"), F.col("hash").alias("ph"))
    j = o.join(n, "id", "full_outer").join(p, "id", "full_outer")
    in_old, in_new, ghost = F.coalesce("in_old", F.lit(False)), F.coalesce("in_new", F.lit(False)), F.coalesce("pg", F.lit(False))
    differs = ~F.col("oh").eqNullSafe(F.col("nh"))
    status = (
        F.when(ghost & in_new & F.col("ph").eqNullSafe(F.col("nh")), F.lit(None))
        .when(ghost & in_new, "modified")
        .when(in_new & ~in_old & F.col("ps").isNull(), "added")
        .when(in_old & ~in_new, "deleted")
        .when(in_old & in_new & differs & ~F.coalesce("ps", F.lit("")).isin("added", "deleted"), "modified")
        .otherwise(F.col("ps"))
    )
    out = j.select("id", status.alias("status"), F.when(in_new, False).otherwise((in_old & ~in_new) | ghost).alias("is_ghost"))
    return out.where("status is not null")


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(caller, callee, status) of pairs in one snapshot only; types don't matter."""
    o = old.select("caller", "callee").distinct().withColumn("o", F.lit(1))
    n = new.select("caller", "callee").distinct().withColumn("n", F.lit(1))
    j = o.join(n, ["caller", "callee"], "full_outer").where("o is null or n is null")
    return j.select("caller", "callee", F.when(F.col("o").isNull(), "added").otherwise("deleted").alias("status"))


def bubble_up(nodes: DataFrame, statuses: DataFrame) -> DataFrame:
    """(id, status): own statuses; ancestors of a changed node without one are modified."""
    up = statuses.select(F.explode(I.ancestors(F.col("id"))).alias("id")).distinct().join(nodes.select("id"), "id", "left_semi")
    own = statuses.select("id", F.col("status").alias("own"))
    return up.join(own, "id", "full_outer").select("id", F.coalesce("own", F.lit("modified")).alias("status"))


def inject(nodes: DataFrame, edges: DataFrame, statuses: DataFrame, ghosts: DataFrame, gone_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with change_status and is_ghost, ghosts among them (under a parent that is live or a ghost, else at the top), and edges with the
    deleted ones that are not live appended."""
    live = nodes.withColumn("is_ghost", F.lit(False))
    both = live.unionByName(ghosts.join(nodes.select("id"), "id", "left_anti").withColumn("is_ghost", F.lit(True)), allowMissingColumns=True)
    marks = bubble_up(both, statuses).withColumnRenamed("status", "change_status")
    shown = both.drop("change_status").join(marks, "id", "left")
    known = both.select(F.col("id").alias("parent")).distinct()
    shown = shown.drop("parent").withColumn("_p", I.parent(F.col("id"))).join(known, F.col("_p") == known["parent"], "left").drop("_p")
    lost = gone_edges.join(edges.select("caller", "callee").distinct(), ["caller", "callee"], "left_anti").withColumn("change_status", F.lit("deleted"))
    return shown, edges.withColumn("change_status", F.lit(None).cast("string")).unionByName(lost, allowMissingColumns=True)


def dismiss(statuses: DataFrame, edge_statuses: DataFrame, node: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Statuses without those of a node and of edges that touch it; without a node, none are left."""
    if node is None:
        return statuses.where("false"), edge_statuses.where("false")
    return statuses.where(F.col("id") != node), edge_statuses.where((F.col("caller") != node) & (F.col("callee") != node))
