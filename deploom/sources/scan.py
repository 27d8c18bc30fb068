"""Finding and reading the source files of a project.

File listing runs on the driver, since Spark's own file sources leave out names that begin with `_` or `.`; contents are read in tasks.
"""

from __future__ import annotations

import fnmatch
import json
import os
import posixpath
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deploom.functions.languages import EXTENSIONS

FILES = "path string, rel_path string, lang string, module string, aliases map<string,string>, source string, source_hash long, mtime_ns long, error string"
JS_MANIFESTS, RS_MANIFESTS = {"package.json", "tsconfig.json"}, {"Cargo.toml"}


#: Folders that are not read, fixed values; names that begin with a dot are left out besides.
EXCLUDED = ("__pycache__", "venv", "node_modules", "dist", "build", "static", "coverage", "target")


@dataclass
class Config:
    """What a scan takes. Keys of a configuration file replace defaults as a whole."""

    extensions: list[str] = field(default_factory=lambda: [".py", ".js", ".jsx", ".ts", ".tsx", ".rs"])
    exclude_dirs: list[str] = field(default_factory=lambda: list(EXCLUDED))
    exclude_patterns: list[str] = field(default_factory=list)


def load_config(project: str, names: tuple[str, ...] = (".deploom.yml", "deploom.yml")) -> Config:
    """The first configuration file found, else the defaults; unknown keys are passed over."""
    for name in names:
        path = Path(project, name)
        if path.is_file():
            import yaml

            given = ((yaml.safe_load(path.read_text()) or {}).get("analysis")) or {}
            return Config(**{k: list(v) for k, v in given.items() if k in Config.__dataclass_fields__})
    return Config()


def walk(project: str, config: Config) -> tuple[list[str], set[str], set[str]]:
    """Sorted paths relative to the project, and the folders (the project itself: empty) that hold manifests of JavaScript and of Rust."""
    out, js, rs = [], set(), set()
    for top, dirs, names in os.walk(project):
        dirs[:] = [d for d in dirs if not d.startswith(".") and d not in config.exclude_dirs]
        here = os.path.relpath(top, project).replace(os.sep, "/")
        here = "" if here == "." else here
        if JS_MANIFESTS & set(names):
            js.add(here)
        if RS_MANIFESTS & set(names):
            rs.add(here)
        for n in names:
            rel = posixpath.join(here, n)
            if not n.startswith(".") and n.endswith(tuple(config.extensions)) and not any(fnmatch.fnmatch(rel, p) for p in config.exclude_patterns):
                out.append(rel)
    return sorted(out), js, rs


def find_files(project: str, config: Config | None = None) -> list[str]:
    """Sorted paths relative to the project; parts that are hidden or excluded are judged below the project only."""
    return walk(project, config or Config())[0]


def python_module(rel: str, files: set[str]) -> str:
    """Dotted name: the folders above that are packages, and the stem; a package's own file has the package's name."""
    parts = rel.split("/")
    stem, folder, chain = parts[-1].rsplit(".", 1)[0], parts[:-1], []
    while folder and "/".join([*folder, "__init__.py"]) in files:
        chain.insert(0, folder[-1])
        folder = folder[:-1]
    if stem == "__init__":
        return ".".join(chain) or stem
    return ".".join([*chain, stem])


def javascript_module(rel: str, manifests: set[str], project_name: str) -> str:
    """Name of the folder of the nearest manifest, the folders below it and the stem; `index` stands for its folder."""
    parts = rel.split("/")
    folder = parts[:-1]
    at = next((k for k in range(len(folder), -1, -1) if "/".join(folder[:k]) in manifests), None)
    stem = parts[-1].rsplit(".", 1)[0]
    tail = [] if stem == "index" else [stem]
    if at is None:
        mark = max((k for k, p in enumerate(folder) if p in ("src", "lib", "packages", "source")), default=-1)
        return ".".join([*folder[mark + 1 :], *tail]) or stem
    name = folder[at - 1] if at else project_name
    return ".".join([name, *folder[at:], *tail])


def import_aliases(project: str, folder: str, manifests: set[str], project_name: str) -> dict[str, str]:
    """Import prefixes that the folder's tsconfig.json maps, in order of name, to dotted names: `x/` for what lies below x, `x` for itself.

    The first target counts. An alias that is empty or a bare `@` is left out, and so are targets outside the project and files that aren't
    plain JSON.
    """
    try:
        found = json.loads(Path(project, folder, "tsconfig.json").read_text())["compilerOptions"]["paths"]
        pairs = sorted((a.removesuffix("/*"), t[0]) for a, t in found.items() if isinstance(t, list) and t and isinstance(t[0], str))
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return {}
    out, root = {}, posixpath.basename(folder) or project_name
    for prefix, target in pairs:
        target = target.removesuffix("/*").rstrip("/")
        stem, ext = posixpath.splitext(target)
        target = stem if ext in (".ts", ".tsx", ".js", ".jsx", ".mjs") else target
        if prefix in ("", "@"):
            continue
        if target == ".." or target.startswith("../"):
            path = posixpath.normpath(posixpath.join(folder, target))
            if path.startswith(".."):
                continue
            path = "" if path == "." else path
            out[prefix + "/"] = javascript_module(posixpath.join(path, "x.ts"), manifests, project_name).removesuffix(".x")
            out[prefix] = javascript_module(f"{path}.ts", manifests, project_name) if path else project_name
        else:
            out[prefix + "/"] = out[prefix] = ".".join([root, *[p for p in target.split("/") if p not in ("", ".")]])
    return out


def rust_module(rel: str, manifests: set[str], project_name: str) -> str:
    """The crate's folder (`-` as `_`) and the path below its src; main, lib and mod stand for their folder."""
    parts = rel.split("/")
    folder = parts[:-1]
    at = next((k for k in range(len(folder), -1, -1) if "/".join(folder[:k]) in manifests), 0)
    crate = (folder[at - 1] if at else project_name).replace("-", "_")
    below = folder[at:]
    below = below[1:] if below[:1] == ["src"] else below
    stem = parts[-1].rsplit(".", 1)[0]
    return ".".join([crate, *below, *([] if stem in ("main", "lib", "mod") else [stem])])


def scan(spark: SparkSession, project: str, config: Config | None = None, texts: bool = True) -> DataFrame:
    """One row for each file with its text; a file that can't be read as UTF-8 has an error and no text. Without texts files aren't opened."""
    config = config or load_config(project)
    found, js, rs = walk(project, config)
    known, rows = set(found), []
    name = os.path.basename(os.path.abspath(project))
    aliases = {folder: import_aliases(project, folder, js, name) for folder in js}
    for rel in found:
        lang = EXTENSIONS.get(rel.rsplit(".", 1)[-1])
        if lang:
            module = python_module(rel, known) if lang == "python" else rust_module(rel, rs, name) if lang == "rust" else javascript_module(rel, js, name)
            above = rel.split("/")[:-1]
            own = next((aliases[f] for f in ("/".join(above[:k]) for k in range(len(above), -1, -1)) if f in js), {}) if lang not in ("python", "rust") else {}
            rows.append((os.path.abspath(os.path.join(project, rel)), rel, lang, module, own))
    return read_files(spark, rows, texts)


def open_file(spark: SparkSession, project: str, rel: str, config: Config | None = None) -> DataFrame:
    """The row of one file; an extension that no language has raises ValueError."""
    if rel.rsplit(".", 1)[-1] not in EXTENSIONS:
        raise ValueError(f"Unsupported language: {rel}")
    config = config or load_config(project)
    one = Config(["/" + rel.rsplit("/", 1)[-1], rel.rsplit("/", 1)[-1]], config.exclude_dirs, config.exclude_patterns)
    return scan(spark, project, one).where(F.col("rel_path") == rel)


def read_files(spark: SparkSession, rows: list[tuple], texts: bool = True) -> DataFrame:
    """FILES of (path, rel_path, lang, module, aliases); contents are read in tasks, and times alone without texts."""
    head = "path string, rel_path string, lang string, module string, aliases map<string,string>"
    listed = spark.createDataFrame(rows, head).repartition(max(1, len(rows) // 64 + 1))

    def read(batches):
        for batch in batches:
            sources, times, errors = [], [], []
            for p in batch.column(0).to_pylist():
                try:
                    sources.append(Path(p).read_bytes().decode("utf-8") if texts else None)
                    times.append(os.stat(p).st_mtime_ns)
                    errors.append(None)
                except (OSError, UnicodeDecodeError) as e:
                    sources.append(None)
                    times.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sources, pa.string()), pa.array(times, pa.int64()), pa.array(errors, pa.string())], [*batch.schema.names, "source", "mtime_ns", "error"])

    out = listed.mapInArrow(read, head + ", source string, mtime_ns long, error string")
    return out.select("path", "rel_path", "lang", "module", "aliases", "source", F.xxhash64("source").alias("source_hash"), "mtime_ns", "error")


def language(path):
    """Language of a path by its extension, null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return table[F.regexp_extract(path, r"\.([^.]+)\z", 1)]


def fingerprint(files: DataFrame, version: int = 1, more: str = "") -> DataFrame:
    """One row: a SHA-256 over the `path:mtime` lines of all files, the version of the schema, and `more` (the configuration).

    Lines are digested in at most 4096 groups, by the MD5 of the path, and the digests of groups in order, so that no task holds all lines.
    """
    line = F.concat("rel_path", F.lit(":"), F.coalesce(F.col("mtime_ns").cast("string"), F.lit("-")))
    groups = files.groupBy(F.substring(F.md5(F.col("rel_path").cast("binary")), 1, 3).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d"))
    lines = groups.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), "\n").alias("l"))
    return lines.select(F.sha2(F.concat_ws("\n", "l", F.lit(str(version)), F.lit(more)), 256).alias("fingerprint"))


def changed_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose text is new or differs from a former scan; seen: (path, source_hash)."""
    return files.join(seen.select("path", "source_hash"), ["path", "source_hash"], "left_anti")
