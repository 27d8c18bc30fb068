"""One short source for each feature of a language, with the events that it stands for (feature_events.py).

An event is one line: its kind and what it names. Source lines and the scope of the module are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deploom.sources import parse

MODULE = "p.q.m"
EXTENSION = {"python": "py", "typescript": "ts", "rust": "rs"}


def event_text() -> Column:
    """An event in one line."""
    empty = F.array().cast("array<string>")
    listed = lambda c: F.concat(F.lit("("), F.array_join(F.coalesce(c, empty), ", "), F.lit(")"))
    renamed = F.when(F.size("aliases") > 0, F.concat(F.lit(" "), F.array_join(F.transform(F.map_entries("aliases"), lambda x: F.concat(x["key"], F.lit(" as "), x["value"])), ", ")))
    of = {
        "ImportStatement": F.concat("module", listed(F.col("names")), F.coalesce(renamed, F.lit("")), F.when(F.col("is_flag"), " typing").otherwise("")),
        "EnterScope": F.concat(F.lower("scope_type"), F.lit(" "), "name", listed(F.col("parameters")), F.when(F.size("bases") > 0, F.concat(F.lit(" of "), F.array_join("bases", ", "))).otherwise("")),
        "ExitScope": F.lower("scope_type"),
        "DefineName": F.concat_ws(" ", "node_type", "name"),
        "UseName": F.col("name"),
        "CallExpression": F.concat("callee", listed(F.col("arguments"))),
        "Assignment": F.concat_ws(" ", "value_type", F.concat("target", F.lit(" = "), "value")),
        "Literal": F.concat_ws(" ", "value_type", "value"),
        "Decorator": F.concat("name", F.when(F.col("is_flag"), listed(F.col("arguments"))).otherwise("")),
        "AttributeAccess": F.concat("object", F.lit("."), "attribute"),
    }
    text = F.concat_ws(" ", "block_type", "condition", "value")
    for kind, found in of.items():
        text = F.when(F.col("kind") == kind, found).otherwise(text)
    return F.trim(F.concat_ws(" ", "kind", text))


def events(spark: SparkSession, lang: str, features: dict[str, tuple[str, str]]) -> DataFrame:
    """(feature, n, event) of the sources of one language."""
    rows = [(f"{name}.{EXTENSION[lang]}", lang, MODULE, source[1:]) for name, (source, _) in features.items()]
    files = spark.createDataFrame(rows, "rel_path string, lang string, module string, source string")
    e = parse.events_of(files).where("kind <> 'SourceLine' and not (kind in ('EnterScope', 'ExitScope') and scope_type = 'Module')")
    return e.select(F.split("file", r"\.")[0].alias("feature"), F.row_number().over(Window.partitionBy("file").orderBy("seq")).alias("n"), event_text().alias("event"))


def expected(features: dict[str, tuple[str, str]]) -> list[tuple[str, int, str]]:
    return [(name, n, line.strip()) for name, (_, lines) in features.items() for n, line in enumerate(lines.strip().split("\n"), 1)]


def flow_files(spark: SparkSession, features: dict[str, tuple[str, str]]) -> DataFrame:
    """One Python module for each feature, named by it."""
    rows = [(f"{name}.py", "python", name, source[1:]) for name, (source, _) in features.items()]
    return spark.createDataFrame(rows, "rel_path string, lang string, module string, source string")


def expected_flow(features: dict[str, tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(owner, from, to, type) of edges given as `from -> to : type`."""
    out = []
    for name, (_, lines) in features.items():
        for line in lines.strip().split("\n"):
            ends, kind = line.rsplit(" : ", 1)
            out.append((f"{name}.f", *ends.split(" -> "), kind))
    return out
