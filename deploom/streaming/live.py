"""Live analysis: a stream of file changes drives re-parsing, rebuilding and diffing, one snapshot after the other.

State is a folder of Parquet snapshots: events, nodes, edges and statuses of version N. A version counts once it is in the log, with the batch
that made it. A batch that failed half-way writes its version again; one that is in the log already is passed over; and a new process goes
on from the last version of the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deploom.functions.storage import remove
from deploom.operators import changes
from deploom.operators.resolve import build
from deploom.sources.parse import events_of

CHANGES = "path string, event_type string, ts timestamp, seq long"
#: Folders whose changes are passed over, fixed values.
IGNORED = ["__pycache__", ".git", ".venv", "venv", "node_modules", ".mypy_cache", ".pytest_cache", ".tox", "dist", "build", "egg-info", "target"]
TABLES = ("events", "nodes", "edges", "statuses", "edge_statuses")


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """File changes from a folder of JSON lines, as a stream."""
    return spark.readStream.schema(CHANGES).json(folder)


def watched(events: DataFrame, extensions: list[str]) -> DataFrame:
    """Events of files with these extensions outside ignored folders."""
    parts = F.split("path", "/")
    return events.where(F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)).isin(extensions) & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in IGNORED])))


def debounced(events: DataFrame, gap: str = "500 milliseconds", late: str = "1 second") -> DataFrame:
    """Sessions of changes with no gap as long as `gap`: first, last and number, once the watermark has passed them. Rows later than `late` go."""
    return changes.sessions(events.withWatermark("ts", late), None, "ts", gap)


def settled(events: DataFrame, gap: str = "500 milliseconds", late: str = "1 second") -> DataFrame:
    """One change for each file that was left alone for `gap`: (path, event_type, ts, seq) of its last event, `created` if any created it.

    A file's changes are combined as they come; none are gathered. Rows later than `late` go.
    """
    groups = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "path")
    kind = F.when(F.bool_or(F.col("event_type") == "created"), "created").otherwise(F.max_by("event_type", "seq"))
    return groups.agg(kind.alias("event_type"), F.max("ts").alias("last"), F.max("seq").alias("seq")).select("path", "event_type", F.col("last").alias("ts"), "seq")


def apply_changes(events: DataFrame, changed: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Parsed events after a batch of coalesced changes (path, event_type): closed paths go, others are read and parsed again.

    read gives files (rel_path, lang, module, source) for changed paths that exist.
    """
    gone = changed.select(F.col("path").alias("file"))
    kept = events.join(gone, "file", "left_anti")
    return kept.unionByName(events_of(read(changed.where("event_type not in ('deleted', 'moved')"))))


class LiveGraph:
    """The latest snapshot, and what has changed since statuses were dismissed.

    The last `keep` versions stay; frames of older ones must not be read any more.
    """

    def __init__(self, spark: SparkSession, folder: str, read: Callable[[DataFrame], DataFrame], keep: int = 3):
        self.spark, self.folder, self.read, self.keep = spark, folder.rstrip("/"), read, max(2, keep)
        self.after: list[Callable[[], object]] = []  # called when a version is complete
        self.version = max((v for v, _, _ in self.log()), default=-1)

    def log(self) -> list[tuple[int, int | None, str | None]]:
        """(version, batch, source) of the versions that are complete and were not dropped."""
        try:
            rows = self.spark.read.parquet(f"{self.folder}/log").select("version", "batch", "source").collect()
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return [tuple(r) for r in rows]

    def load(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/v={self.version if version is None else version}")

    def save(self, version: int, **frames: DataFrame) -> None:
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/v={version}")

    def commit(self, version: int, batch: int | None = None, source: str | None = None) -> None:
        """Makes a version the latest one; a version of no batch hands on that of the version before."""
        log = self.log()
        if batch is None and log:
            _, batch, source = max(log, key=lambda r: r[0])
        self.save(version, log=self.spark.createDataFrame([(version, batch, source)], "version long, batch long, source string").coalesce(1))
        self.version = version
        old = [v for v, _, _ in log if v <= version - self.keep]
        remove(self.spark, *[f"{self.folder}/{name}/v={v}" for v in old for name in ("log", "document", *TABLES)])
        for call in self.after:
            call()

    def start(self, files: DataFrame) -> None:
        """The first snapshot, or the next one if there are some; it has no statuses."""
        version = self.version + 1
        self.save(version, events=events_of(files))
        nodes, edges = build(self.load("events", version))
        none = self.spark.createDataFrame([], "id string, status string, is_ghost boolean, hash string")
        gone = self.spark.createDataFrame([], "caller string, callee string, status string")
        self.save(version, nodes=nodes, edges=edges, statuses=none, edge_statuses=gone)
        self.commit(version)

    def step(self, changed: DataFrame, batch: int | None = None, source: str | None = None) -> None:
        """One batch of raw changes: coalesce, parse what changed, rebuild, diff, write the next snapshot. Batches of one source (the folder of
        a query's checkpoint) that the log has already change nothing."""
        if batch is not None and any(s == source and b is not None and b >= batch for _, b, s in self.log()):
            return
        before, version = self.version, self.version + 1
        last = changes.coalesce_events(changed, "path", "event_type", "seq")
        self.save(version, events=apply_changes(self.load("events"), last, self.read))
        nodes, edges = build(self.load("events", version))
        self.save(version, nodes=nodes, edges=edges)
        key = F.coalesce("content_hash", F.md5(F.coalesce("code_block", F.lit("")).cast("binary"))).alias("hash")
        mine = lambda v: changes.flatten_origin(self.load("nodes", v)).where("origin is null or origin = 'local'").join(self.load("nodes", v).drop("origin"), "id").select("id", key)
        old, new = mine(before), mine(version)
        status = changes.node_diff(old, new, self.load("statuses", before))
        hashes = old.withColumnRenamed("hash", "old_hash").join(self.load("statuses", before).select("id", F.col("hash").alias("ghost_hash")), "id", "full_outer")
        status = status.join(hashes, "id", "left").select("id", "status", "is_ghost", F.when(F.col("is_ghost"), F.coalesce("old_hash", "ghost_hash")).alias("hash"))
        was = self.load("edge_statuses", before).join(changes.edge_diff(self.load("edges", before), self.load("edges", version)).select("caller", "callee"), ["caller", "callee"], "left_anti")
        here = self.load("edges", version).select("caller", "callee").distinct()
        stay = was.where("status = 'deleted'").join(here, ["caller", "callee"], "left_anti")
        self.save(version, statuses=status, edge_statuses=stay.unionByName(changes.edge_diff(self.load("edges", before), self.load("edges", version))))
        self.commit(version, batch, source)

    def view(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges with their statuses; deleted ones are ghosts."""
        statuses, nodes, edges = self.load("statuses"), self.load("nodes"), self.load("edges")
        gone = self.load("edge_statuses").where("status = 'deleted'").select("caller", "callee")
        return changes.inject(nodes, edges, statuses.select("id", "status"), statuses.where("is_ghost").select("id"), gone)

    def dismiss(self, node: str | None = None) -> None:
        s, e = changes.dismiss(self.load("statuses"), self.load("edge_statuses"), node)
        version = self.version + 1
        self.save(version, statuses=s, edge_statuses=e, nodes=self.load("nodes"), edges=self.load("edges"), events=self.load("events"))
        self.commit(version)

    def follow(self, stream: DataFrame, checkpoint: str, extensions: list[str] | None = None, gap: str | None = None, late: str = "1 second", **trigger):
        """Runs step() on every batch of a stream of changes, of watched files if `extensions` are given, and of files that were left alone for
        `gap` if one is given (their changes come once the watermark has passed them). Without a gap the trigger's interval paces the batches."""
        if extensions:
            stream = watched(stream, extensions)
        if gap:
            stream = settled(stream, gap, late)

        def batch(df: DataFrame, n: int) -> None:
            if not df.isEmpty():
                self.step(df, n, checkpoint)

        return stream.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()
