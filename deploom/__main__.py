"""Command line: `python -m deploom analyze|catalog|stats PATH`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from deploom.api import Project


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="deploom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("analyze", "catalog", "stats"):
        c = commands.add_parser(name)
        c.add_argument("path")
        c.add_argument("--include-standard", action="store_true")
        c.add_argument("--include-third-party", action="store_true")
        if name == "analyze":
            c.add_argument("--select")
            c.add_argument("--exclude")
            c.add_argument("--state", action="append")
            c.add_argument("--pretty", action="store_true")
            c.add_argument("--edges-only", action="store_true")
            c.add_argument("-o", "--output")
        if name == "catalog":
            c.add_argument("patterns", nargs="*")
            c.add_argument("--no-assignments", action="store_true")
    a = parser.parse_args(arguments)
    project = Project(spark or SparkSession.builder.appName("deploom").getOrCreate(), a.path)
    origins = {"include_standard": a.include_standard, "include_third_party": a.include_third_party}
    if a.command == "analyze":
        text = project.export(a.output, a.pretty, a.edges_only, select=a.select, exclude=a.exclude, states=a.state, **origins)
        if not a.output:
            print(text)
    elif a.command == "catalog":
        rows = project.catalog(a.patterns or None, no_assignments=a.no_assignments, **origins).orderBy("id")
        n = 0
        for row in rows.toLocalIterator():
            print(row["id"], row["type"], sep="\t")
            n += 1
        print(n, "items")
    else:
        for row in project.stats(**origins).orderBy("metric", "key").toLocalIterator():
            print(*row, sep="\t")


if __name__ == "__main__":
    main()
