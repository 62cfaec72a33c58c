"""Project-wide facts: counts, URLs, endpoints, names of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import document_name, path_digest


def files_by_language(files: DataFrame, language: str = "language") -> DataFrame:
    return files.groupBy(F.col(language).alias("language")).agg(F.count(F.lit(1)).alias("files"))


def function_count(functions: Column, classes: Column) -> Column:
    """Functions and the methods of all classes."""
    return F.size(functions) + F.aggregate(F.transform(classes, lambda c: F.size(c["methods"])), F.lit(0), lambda a, b: a + b)


def first_urls(urls: DataFrame) -> DataFrame:
    """(url, path, line): where each URL is first found, in order of path and line."""
    return urls.groupBy("url").agg(F.min(F.struct("path", "line")).alias("at")).select("url", "at.path", "at.line")


def named_documents(files: DataFrame) -> DataFrame:
    """(path, kb_name): names of rendered documents; of paths with one name all but the first get a digest."""
    return _numbered(files).select("path", F.when(F.col("n") == 1, F.col("plain")).otherwise(_other_name()).alias("kb_name"))


def renamed_documents(files: DataFrame) -> DataFrame:
    """Those rows of :func:`named_documents` whose name has a digest for a clash."""
    return _numbered(files).where("n > 1").select("path", _other_name().alias("kb_name"))


def _numbered(files: DataFrame) -> DataFrame:
    same = Window.partitionBy("plain").orderBy("path")
    return files.select("path").distinct().withColumn("plain", document_name(F.col("path"))).withColumn("n", F.row_number().over(same))


def _other_name() -> Column:
    return F.concat(F.regexp_replace("plain", r"\.md$", ""), F.lit("__"), path_digest(F.col("path")), F.lit(".md"))


def mean_min_max(runs: DataFrame, by: str, value: str) -> DataFrame:
    return runs.groupBy(by).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def targets(rows: DataFrame, tier: str | None = None, ids: set[str] | None = None, languages: set[str] | None = None) -> DataFrame:
    """Benchmark targets (id, tier, languages) by tier, id and overlap of languages."""
    if tier:
        rows = rows.where(F.col("tier") == tier)
    if ids:
        rows = rows.where(F.col("id").isin(*sorted(ids)))
    if languages:
        rows = rows.where(F.arrays_overlap("languages", F.array(*[F.lit(x) for x in sorted(languages)])))
    return rows
