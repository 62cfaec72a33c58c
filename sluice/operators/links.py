"""Imports to files: the dependency graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import base_name, suffix
from ..functions.text import let


def stem(path: Column) -> Column:
    name, end = base_name(path), suffix(base_name(path))
    return F.substring(name, F.lit(1), F.length(name) - F.length(end))


def import_tokens(stmt: Column) -> Column:
    """Words of an import statement, without quotes and closing signs."""
    words = F.transform(F.split(stmt, r"[\s,]+"), lambda t: F.btrim(t, F.lit("\"'`;()")))
    return F.array_distinct(F.filter(words, lambda t: t != ""))


def stems(files: DataFrame) -> DataFrame:
    """(token, target): the smallest path of each stem, and of ``stem_suffix``."""
    s, end = stem(F.col("path")), F.substring(suffix(base_name(F.col("path"))), 2, 99)
    keys = files.select("path", F.explode(F.array_distinct(F.array(s, F.concat_ws("_", s, end)))).alias("token"))
    return keys.groupBy("token").agg(F.min("path").alias("target"))


def edges_by_stem(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target): a word of an import is the stem of a file. imports: (path, stmt)."""
    tokens = imports.select(F.col("path").alias("source"), F.explode(import_tokens(F.col("stmt"))).alias("token"))
    return tokens.join(stems(files), "token").where("source <> target").select("source", "target").distinct()


def import_target(stmt: Column, language: Column) -> Column:
    """What an import statement names, as its language writes it; null if it names nothing."""
    s = F.btrim(stmt)
    group = lambda p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
    java = group(r"^import\s+(?:static\s+)?([\w.*]+)\s*;?$")
    script = F.coalesce(group(r"from\s+[\"']([^\"']+)[\"']"), group(r"require\s*\(\s*[\"']([^\"']+)[\"']"), group(r"^import\s+[\"']([^\"']+)[\"']"))
    python = F.coalesce(group(r"^from\s+([\w.]+)\s+import\b"), group(r"^import\s+([\w.]+)"))
    kotlin = group(r"^import\s+([\w.*]+)")
    csharp = group(r"^using\s+(?:static\s+)?([\w.]+)\s*;?$")
    return F.when(language == "java", java).when(language.isin("javascript", "typescript"), script).when(language == "python", python).when(language == "kotlin", kotlin).when(language == "csharp", csharp)


def _resolved(folder: Column, relative: Column) -> Column:
    """A relative path put on a folder, ``.`` and ``..`` worked off."""
    parts = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda p: ~p.isin("", "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(done, "/")


#: By language: what follows the place that an import names, the likeliest first.
ENDINGS = {"python": (".py", "/__init__.py"), "java": (".java",), "kotlin": (".kt", ".java"), "csharp": (".cs",)}
ENDINGS |= dict.fromkeys(("javascript", "typescript"), ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts"))


def candidates(named: DataFrame) -> DataFrame:
    """(source, item, ord, end, exact): what each import may stand for, the likeliest first.

    ``named`` has source, language, stmt and wanted. ``end`` is a path or the end of one, the
    whole path where ``exact``; ``stem:x`` is any file of that stem. Items are resolved each on
    its own: an import is one, and so is each name that ``from . import`` lists.
    """
    python, script = F.col("language") == "python", F.col("language").isin("javascript", "typescript")
    relative, wanted, folder = F.startswith("wanted", F.lit(".")), F.col("wanted"), F.regexp_replace("source", r"/?[^/]*$", "")
    # Dots of Python: the first is this folder, each further one the folder above.
    bare = F.regexp_replace(wanted, r"^\.+", "")
    below = F.when(python, F.concat(F.repeat(F.lit("../"), F.length(wanted) - F.length(bare) - 1), F.regexp_replace(bare, r"\.", "/"))).otherwise(wanted)
    base = F.when(relative, _resolved(folder, below)).otherwise(F.regexp_replace(wanted, r"\.", "/"))
    rows = named.where(~script | relative).select("source", "language", "stmt", "wanted", folder.alias("folder"), relative.alias("relative"), base.alias("base"))
    endings = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in ENDINGS.items() for x in kv])
    whole = rows.select("source", F.col("stmt").alias("item"), (python & F.col("relative")).alias("exact"), "base", F.posexplode(endings[F.col("language")]).alias("ord", "ending"))
    whole = whole.select("source", "item", "ord", F.concat("base", "ending").alias("end"), "exact")
    absolute = rows.where(python & ~F.col("relative"))
    first = F.regexp_extract("base", "^[^/]*", 0)
    further = F.array(
        F.struct(F.lit(2).alias("ord"), F.when(F.contains("base", F.lit("/")), F.concat(F.regexp_replace("base", "/[^/]*$", ""), F.lit(".py"))).alias("end"), F.lit(False).alias("exact")),
        F.struct(F.lit(3).alias("ord"), F.concat(F.concat_ws("/", F.nullif("folder", F.lit("")), first), F.lit(".py")).alias("end"), F.lit(True).alias("exact")),
        F.struct(F.lit(4).alias("ord"), F.concat(F.lit("stem:"), first).alias("end"), F.lit(False).alias("exact")),
    )
    further = absolute.select("source", F.col("stmt").alias("item"), F.inline(further)).where("end is not null")
    # ``from . import a, b as c``: the package, by the rows above, and each name that is a file in it.
    listed = F.split(F.regexp_replace(F.regexp_extract("stmt", r"(?s)\bimport\s+(.*)$", 1), r"[()\\\s]+", " "), ",")
    names = rows.where(python & F.rlike("wanted", F.lit(r"^\.+$"))).select("source", "stmt", "base", F.explode(F.transform(listed, lambda n: F.regexp_extract(n, r"^\s*(\w+)", 1))).alias("name")).where("name <> ''")
    names = names.select("source", F.concat_ws("\n", "stmt", "name").alias("item"), F.concat(F.concat_ws("/", F.nullif("base", F.lit("")), "name"), F.lit(".py")).alias("end"))
    names = names.select("source", "item", F.lit(0).alias("ord"), "end", F.lit(True).alias("exact"))
    return whole.unionByName(further).unionByName(names)


def path_ends(files: DataFrame) -> DataFrame:
    """(end, path, whole): each path by all its ends, however deep it is, so that ends can be joined by equality."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/"))
    return files.select("path", F.explode(ends).alias("end")).withColumn("whole", F.col("end") == F.col("path"))


def edges_resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target): each import's first candidate, whole paths before ends, then by path.

    imports: (path, language, stmt). ``x.*`` of the JVM links every file of that package's folder.
    Of the files with one end only the two least can be chosen (two, as a file isn't linked to
    itself); the others go before anything is joined, so that common ends don't fan out.
    """
    named = imports.select(F.col("path").alias("source"), "language", "stmt", import_target(F.col("stmt"), F.col("language")).alias("wanted")).where("wanted is not null").distinct()
    ends = path_ends(files).unionByName(files.select(F.concat(F.lit("stem:"), stem(F.col("path"))).alias("end"), "path", F.lit(False).alias("whole")))
    least = Window.partitionBy("end").orderBy(F.desc("whole"), "path")
    ends = ends.withColumn("n", F.row_number().over(least)).where("n <= 2").drop("n")
    tried = candidates(named.where("not endswith(wanted, '*')"))
    found = tried.join(ends, "end").where("source <> path and (whole or not exact)")
    first = Window.partitionBy("source", "item").orderBy("ord", F.desc("whole"), "path")
    single = found.withColumn("n", F.row_number().over(first)).where("n = 1").select("source", F.col("path").alias("target"))
    folders = files.select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("path_of")).where("path like '%/%'")
    package_ends = path_ends(folders.select(F.col("path_of").alias("path")).distinct()).select("end", F.col("path").alias("path_of"))
    package = named.where("endswith(wanted, '.*')").select("source", F.regexp_replace(F.expr("substring(wanted, 1, length(wanted) - 2)"), r"\.", "/").alias("end"))
    wild = package.join(package_ends, "end").join(folders, "path_of").where("source <> path").select("source", F.col("path").alias("target"))
    return single.unionByName(wild).distinct()
