"""Indexing a source tree, and bundling what the index holds: the entry points of the library.

    python -m sluice.api init PATH [--languages python,js] [--verbose]
    python -m sluice.api bundle PATH [--output FILE] [--verbose]

``init`` reads the tree, parses what changed since the last run (by size and time), links imports
to files and writes one Markdown document a file and an index below ``PATH/.sluice``. Documents
of files that are gone are removed. ``bundle`` joins them into one text.
"""

from __future__ import annotations

import argparse
import itertools
import logging
import os
import shutil
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.languages import language_filter
from .functions.text import human_size, token_estimate
from .operators import links, parsers, project, render, stack
from .schemas import PARSED
from .sources.repository import read_repository
from .streaming.snapshot import Store, deleted, merged

FOLDER = ".sluice"
log = logging.getLogger("sluice")


def setup_logging(verbose: bool = False, file: str | None = None, console: bool = True) -> None:
    """Log to the console, a file or both."""
    log.handlers.clear()
    log.setLevel(logging.DEBUG if verbose else logging.INFO)
    for handler in [*([logging.StreamHandler()] if console else []), *([logging.FileHandler(file)] if file else [])]:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)


def with_links(parsed: DataFrame, resolved: bool = True) -> tuple[DataFrame, DataFrame]:
    """(parsed with ``internal_dependencies``, edges (source, target)).

    ``resolved`` follows each language's rules; otherwise a word of an import that is a file's
    stem links to it.
    """
    imports = parsed.select("path", "language", F.explode("imports").alias("stmt"))
    files = parsed.select("path")
    edges = links.edges_resolved(imports, files) if resolved else links.edges_by_stem(imports, files)
    each = edges.groupBy(F.col("source").alias("path")).agg(F.array_sort(F.collect_set("target")).alias("internal_dependencies"))
    return parsed.join(each, "path", "left").withColumn("internal_dependencies", F.coalesce("internal_dependencies", F.array().cast("array<string>"))), edges


def chosen_languages(parsed: DataFrame, languages: set[str]) -> DataFrame:
    """With kubernetes but not yaml in the filter, yaml files that are no manifests go."""
    if "kubernetes" in languages and "yaml" not in languages:
        return parsed.where((F.col("language") == "kubernetes") | F.col("language").isin(*(languages - {"kubernetes"})))
    return parsed


def detect_stack(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Packages by ecosystem, as the tree's manifests name them."""
    found = [(os.path.relpath(os.path.join(folder, n), root), folder) for folder, folders, names in _walk(root) for n in names if n in stack.MANIFESTS]
    rows = []
    for path, _ in sorted(found):
        try:
            with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
                rows.append((path, f.read()))
        except OSError:
            continue
    manifests = spark.createDataFrame(rows, "path string, content string")
    packages = stack.packages(manifests)
    java = stack.prioritised(packages.where("ecosystem = 'java_packages'"), "ecosystem", "package", "ord").orderBy(F.desc("spring"), "rank")
    out = {"java_packages": [r["package"] for r in java.collect()]}
    others = packages.where("ecosystem <> 'java_packages'").groupBy("ecosystem", "package").agg(F.min("ord").alias("o")).orderBy("ecosystem", "o", "package")
    for r in others.collect():
        out.setdefault(r["ecosystem"], []).append(r["package"])
    return {k: v for k, v in out.items() if v}


def _walk(root: str):
    from .sources.repository import skipped_folder

    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if not skipped_folder(f))
        yield folder, folders, names


def write_documents(documents: DataFrame, folder: str) -> None:
    """One file a row of (kb_name, markdown), written by the tasks; a name is replaced in one step."""

    def write(rows):
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            at = os.path.join(folder, r["kb_name"])
            part = f"{at}.{os.getpid()}.part"
            with open(part, "w", encoding="utf-8") as f:
                f.write(r["markdown"])
            os.replace(part, at)

    documents.select("kb_name", "markdown").foreachPartition(write)


def init(spark: SparkSession, path: str, languages: str = "", force: bool = False, resolved: bool = True) -> dict:
    """Index a tree; the counts of what was found, parsed, taken over and removed."""
    root = os.path.abspath(path)
    asked = language_filter(languages)
    out = os.path.join(root, FOLDER)
    if force:
        shutil.rmtree(out, ignore_errors=True)
    found = [tuple(r) for r in read_repository(spark, root, languages, content="false").drop("content").collect()]
    if not found:
        return {"discovered": 0, "parsed": 0, "reused": 0, "deleted": 0}
    # One listing for all that is counted; the texts are read by the tasks, once.
    listed = spark.createDataFrame(found, "path string, size long, mtime_ns long")
    store = Store(spark, f"file://{out}/cache", PARSED)
    filters = {"languages": sorted(asked)}
    old = store.load(filters)
    files = read_repository(spark, root, languages)
    reused = listed.join(old.select("path", "size", "mtime_ns"), ["path", "size", "mtime_ns"], "left_semi").count()
    gone = deleted(listed, old).count()
    held = store.save(merged(files, old, parsers.parsed), filters)
    linked, edges = with_links(chosen_languages(held, asked), resolved)
    documents = render.modules(linked)
    folder = os.path.join(out, "modules")
    write_documents(documents, folder)
    names = documents.select("path", "kb_name")
    index = linked.join(names, "path").select("path", "language", F.size("classes"), project.function_count(F.col("functions"), F.col("classes")), "kb_name").orderBy("path").collect()
    kept = {r["kb_name"] for r in index}
    for name in os.listdir(folder) if os.path.isdir(folder) else []:
        if name not in kept:
            os.remove(os.path.join(folder, name))
    urls = project.first_urls(linked.select("path", F.inline("external_urls")).select("path", "url", "line")).orderBy("path", "line", "url").collect()
    ends = linked.select("path", F.posexplode("database_endpoints").alias("n", "e")).orderBy("path", "n").select("e.connection_type", "e.host", "e.port", "e.user", "e.schema", "e.database", "path", "e.line").collect()
    by_language = project.files_by_language(linked).orderBy("language").collect()
    text = render.project_index(root, detect_stack(spark, root), by_language, edges.orderBy("source", "target").collect(), urls, ends, index)
    with open(os.path.join(out, "project_index.md"), "w", encoding="utf-8") as f:
        f.write(text)
    return {"discovered": len(found), "parsed": len(index), "reused": reused, "deleted": gone}


class NothingToBundle(Exception):
    pass


def bundle_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of the index and the documents below a folder of ``init``.

    The names are listed on the driver and read by the tasks: built-in sources leave out ``_env.md``.
    """
    modules = os.path.join(folder, "modules")
    names = ["project_index.md"] * os.path.isfile(os.path.join(folder, "project_index.md")) + [f"modules/{n}" for n in (sorted(os.listdir(modules)) if os.path.isdir(modules) else []) if n.endswith(".md")]

    @F.pandas_udf("string")
    def read(paths):
        import pandas as pd

        out = []
        for p in paths:
            with open(os.path.join(folder, p), encoding="utf-8", errors="replace") as f:
                out.append(f.read())
        return pd.Series(out)

    return spark.createDataFrame([(n,) for n in names], "name string").select("name", read("name").alias("text"))


def bundle(spark: SparkSession, path: str, output: str | None = None) -> dict:
    """Join the documents of a tree into one text, written to ``output``; its measures."""
    root = os.path.abspath(path)
    parts = bundle_files(spark, os.path.join(root, FOLDER))
    piece = F.concat(F.lit("<!-- part: "), F.col("name"), F.lit(" -->\n\n"), F.rtrim("text", F.lit(" \t\r\n")))
    pieces = parts.select((F.col("name") != "project_index.md").alias("k"), F.lower("name").alias("l"), "name", piece.alias("t")).orderBy("k", "l", "name").select("t")
    title = f"<!-- Project bundle: {os.path.basename(root)} -->\n<!-- Index first, then one part a file, by name. -->\n<!-- Passwords are redacted. -->"
    at, n, measured = output or os.path.join(root, FOLDER, "bundle.md"), 0, [0, 0, 0]
    part = f"{at}.part"
    with open(part, "w", encoding="utf-8", newline="") as f:
        # Parts come one partition at a time: the driver never holds the whole text.
        for text in itertools.chain([title], ("\n\n" + r["t"] for r in pieces.toLocalIterator()), ["\n"]):
            f.write(text)
            n += 1
            measured = [x + y for x, y in zip(measured, (len(text), len(text.split()), len(text.encode())))]
    if n == 2:
        os.remove(part)
        raise NothingToBundle(f"no documents below {os.path.join(root, FOLDER)}: run init first")
    os.replace(part, at)
    characters, words, size = measured
    sizes = spark.range(1).select(human_size(F.lit(size)).alias("size_human"), token_estimate(F.lit(characters)).alias("tokens_estimate")).first()
    return {"output": at, "parts": n - 2, "characters": characters, "words": words, "bytes": size} | sizes.asDict()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sluice")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "bundle"):
        p = commands.add_parser(name)
        p.add_argument("path", nargs="?", default=".")
        p.add_argument("--verbose", "-v", action="store_true")
        p.add_argument("--log-file")
        if name == "init":
            p.add_argument("--languages", default="")
            p.add_argument("--workers", type=int, default=0)
            p.add_argument("--force", action="store_true")
        else:
            p.add_argument("--output")
    args = parser.parse_args(argv)
    setup_logging(args.verbose, args.log_file)
    if not os.path.isdir(args.path):
        log.error("%s is no folder", args.path)
        return 1
    if args.command == "bundle" and not os.path.isdir(os.path.join(args.path, FOLDER)):
        log.error("nothing to bundle: run init first")
        return 1
    workers = getattr(args, "workers", 0) or min(os.cpu_count() or 4, 8)
    active = SparkSession.getActiveSession()
    spark = active or SparkSession.builder.master(f"local[{workers}]").appName("sluice").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        found = init(spark, args.path, args.languages, args.force) if args.command == "init" else bundle(spark, args.path, args.output)
    except NothingToBundle as e:
        log.error("%s", e)
        return 1
    finally:
        if not active:
            spark.stop()
    print("\n".join(f"{k}: {v}" for k, v in found.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
