"""The front: analyse a project, select from its graph, list and count, export."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deploom.operators import document, filters, selector, stats
from deploom.operators.flow import attach, flow_graphs
from deploom.operators.resolve import build
from deploom.functions.storage import shared_dir, written
from deploom.sources.parse import events_of
from deploom.sources.scan import Config, fingerprint, load_config, scan


class Project:
    """A project whose nodes and edges are kept by fingerprint. Where a snapshot of the files as they are exists, none is read or parsed; texts and events
    are then made when they are first asked for."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, cache: str | None = None):
        self.spark, self.path = spark, path
        self.config = config = config or load_config(path)
        mark = fingerprint(scan(spark, path, config, texts=False), more=repr(config)).first()[0]
        folder = f"{(cache or shared_dir(spark)).rstrip('/')}/graph-{mark}"
        try:
            self.nodes, self.edges = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
        except Exception as e:  # no such snapshot yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            nodes, edges = build(self.events)
            nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
            edges.write.mode("overwrite").parquet(f"{folder}/edges")
            self.nodes, self.edges = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")

    @cached_property
    def files(self) -> DataFrame:
        return written(scan(self.spark, self.path, self.config))

    @cached_property
    def events(self) -> DataFrame:
        return written(events_of(self.files))

    def graph(self, select: str | None = None, exclude: str | None = None, states: list[str] | None = None, include_standard: bool = False, include_third_party: bool = False) -> tuple[DataFrame, DataFrame]:
        """Origins first, then the selection, then states."""
        nodes, edges = filters.origin_tree(self.nodes, self.edges, include_standard, include_third_party)
        nodes, edges = selector.select_graph(nodes, edges, select, exclude)
        return filters.state_filter(nodes, edges, states) if states else (nodes, edges)

    def catalog(self, patterns: list[str] | None = None, **options) -> DataFrame:
        return filters.flatten(filters.catalog(self.nodes, patterns, **options))

    def stats(self, **options) -> DataFrame:
        return stats.summary(self.nodes, self.edges, **options)

    def flow(self) -> tuple[DataFrame, DataFrame]:
        return flow_graphs(self.events)

    def with_flow(self) -> DataFrame:
        """Nodes with the flow graphs of functions and modules."""
        return attach(self.nodes, *self.flow())

    def export(self, output: str | None = None, pretty: bool = False, edges_only: bool = False, **options) -> str | None:
        """The JSON of graph(**options), without flow graphs. With an output file it goes there line by line and none is returned; a pretty one passes through the driver whole."""
        nodes, edges = self.graph(**options)
        nodes = filters.strip_flow(nodes)
        if not output:
            return to_json(nodes, edges, pretty, edges_only)
        with open(output, "w", encoding="utf-8") as f:
            if pretty:
                f.write(to_json(nodes, edges, pretty, edges_only))
            else:
                f.writelines(f"{x}\n" for x in json_lines(nodes, edges, edges_only))
        return None

    def export_folder(self, path: str, **options) -> None:
        """The same document as text files in a folder of shared storage, written by tasks: joined by name they are the JSON."""
        nodes, edges = self.graph(**options)
        document.write_document(document.document(filters.strip_flow(nodes), edges), path)

    def catalog_document(self, include_standard: bool = True, include_third_party: bool = True, states: list[str] | None = None) -> DataFrame:
        """(section, place, text): lines of the nested catalog with the number of its nodes."""
        return document.catalog_document(filters.api_catalog(self.nodes, self.edges, include_standard, include_third_party, states))


def json_lines(nodes: DataFrame, edges: DataFrame, edges_only: bool = False) -> Iterator[str]:
    """The lines of a graph's document, or of the list of its edges, a partition at a time on the driver."""
    lines = document.document(nodes, edges)
    if not edges_only:
        yield from document.stream(lines)
        return
    yield "["
    yield from document.stream(lines.where(F.col("section") == document.EDGES))
    yield "]"


def to_json(nodes: DataFrame, edges: DataFrame, pretty: bool = False, edges_only: bool = False) -> str:
    """The nested document as one text, for a graph that fits the driver. Null fields are left out."""
    text = "".join(json_lines(nodes, edges, edges_only))
    return json.dumps(json.loads(text), indent=2) if pretty else text
