"""A graph of resolved names that is kept up to date file by file.

Tables lie in buckets: what a file defines, what it refers to and the edges that it gave by the file's name; definitions by their id, and references
once more by the last segment of their name, which every key that they try ends in. A change of some files reads and overwrites only the buckets that it touches: rows of these files go and come anew, and of all other files only
those references resolve again that try a key which was defined or taken away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deploom.functions import ids as I
from deploom.functions.storage import remove, remove_written, written

from .resolve import Names, resolve_names

#: Columns of each table, and the one that its bucket comes from.
TABLES = {
    "edges": ("file string, caller string, name string, callee string", "file"),
    "tries": ("last string, file string, scope string, name string", "last"),
    "refs": ("file string, scope string, name string", "file"),
    "names": ("id string, object_type string, file string", "id"),
    "defs": ("file string, id string, object_type string", "file"),
}


class NameGraph:
    """Edges (file, caller, name, callee) of references to the innermost definition that their scope sees.

    defs: (file, id, object_type), refs: (file, scope, name); repeated rows count once. A step that failed half-way is made good by the same
    step again: what files defined before is overwritten last.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.touched: dict[str, int] = {}  # buckets that the last step wrote

    def create(self) -> NameGraph:
        for name, (columns, _) in TABLES.items():
            self.spark.createDataFrame([], columns + ", bucket int").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}")
        return self

    def load(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        df = self.spark.read.schema(TABLES[name][0] + ", bucket int").parquet(f"{self.folder}/{name}")
        return (df if buckets is None else df.where(F.col("bucket").isin(buckets))).drop("bucket")

    def bucket(self, column):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def buckets_of(self, *columns: DataFrame) -> list[int]:
        """Buckets of the values in frames of one column; as many as the graph has at most."""
        found: set[int] = set()
        for df in columns:
            found |= {r[0] for r in df.select(self.bucket(F.col(df.columns[0]))).distinct().collect()}
        return sorted(found)

    def replace(self, name: str, buckets: list[int], rows: DataFrame) -> None:
        """Overwrites buckets of a table with rows, which are distinct; buckets without a row are removed."""
        key = TABLES[name][1]
        staged = written(rows.withColumn("bucket", self.bucket(F.col(key))).repartition("bucket"))
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{name}")
        filled = {r[0] for r in staged.select("bucket").distinct().collect()}
        remove(self.spark, *[f"{self.folder}/{name}/bucket={b}" for b in buckets if b not in filled])
        remove_written(staged)
        self.touched[name] = len(buckets)

    @staticmethod
    def keys(refs: DataFrame) -> DataFrame:
        """(key, file, scope, name): what a reference tries, from its scope outwards."""
        tried = refs.select("file", "scope", "name", F.explode(I.ancestors(F.col("scope"), True)).alias("prefix"))
        return tried.select(F.concat("prefix", F.lit("."), "name").alias("key"), "file", "scope", "name")

    def resolve(self, refs: DataFrame, names: DataFrame) -> DataFrame:
        none = self.spark.createDataFrame([], "key string, value string")
        found = resolve_names(refs, Names(names.select("id", "object_type").distinct(), none, none.select(F.col("key").alias("name"))))
        return refs.join(found, ["scope", "name"]).select("file", F.col("scope").alias("caller"), "name", F.col("resolved").alias("callee"))

    def apply(self, changed: DataFrame, defs: DataFrame, refs: DataFrame) -> None:
        """One step. changed: (file) of files that are new, altered or gone; defs and refs: all rows of those that are there now."""
        files = written(changed.select("file").where("file is not null").distinct())
        mine = lambda df: df.join(files, "file", "left_semi")
        others = lambda df: df.join(files, "file", "left_anti")
        new_defs, new_refs = written(mine(defs).select("file", "id", "object_type").distinct()), written(mine(refs).select("file", "scope", "name").distinct())
        by_file = self.buckets_of(files)
        old_defs, old_refs = written(mine(self.load("defs", by_file))), written(mine(self.load("refs", by_file)))
        # Keys that were defined or taken away, or are of another kind now.
        a, b = old_defs.select("id", "object_type"), new_defs.select("id", "object_type")
        moved = written(a.exceptAll(b).unionByName(b.exceptAll(a)).select(F.col("id").alias("key")).distinct())
        ends = written(moved.select(I.last(F.col("key")).alias("last")).distinct())
        near = others(self.load("tries", self.buckets_of(ends)).join(ends, "last", "left_semi"))
        again = written(self.keys(near).join(moved, "key", "left_semi").select("file", "scope", "name").distinct())
        todo = written(new_refs.unionByName(again))
        by_tried = self.buckets_of(self.keys(todo).select("key"))
        # Definitions as they are after this step, in the buckets that are looked up.
        names = others(self.load("names", by_tried)).unionByName(new_defs.select("id", "object_type", "file").where(self.bucket(F.col("id")).isin(by_tried)))
        edges = written(self.resolve(todo, names))
        by_edge = sorted({*by_file, *self.buckets_of(again.select("file"))})
        stay = others(self.load("edges", by_edge)).join(again.select("file", F.col("scope").alias("caller"), "name"), ["file", "caller", "name"], "left_anti")
        self.replace("edges", by_edge, stay.select("file", "caller", "name", "callee").unionByName(edges))
        ended = lambda df: df.select(I.last(F.col("name")).alias("last"), "file", "scope", "name")
        by_key = self.buckets_of(ended(old_refs).select("last"), ended(new_refs).select("last"))
        self.replace("tries", by_key, others(self.load("tries", by_key)).select("last", "file", "scope", "name").unionByName(ended(new_refs)))
        self.replace("refs", by_file, others(self.load("refs", by_file)).select("file", "scope", "name").unionByName(new_refs))
        by_id = self.buckets_of(old_defs.select("id"), new_defs.select("id"))
        self.replace("names", by_id, others(self.load("names", by_id)).select("id", "object_type", "file").unionByName(new_defs.select("id", "object_type", "file")))
        self.replace("defs", by_file, others(self.load("defs", by_file)).select("file", "id", "object_type").unionByName(new_defs))
        remove_written(files, new_defs, new_refs, old_defs, old_refs, moved, ends, again, todo, edges)
