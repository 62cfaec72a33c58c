"""The technology stack that manifests name. manifests: (path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import base_name
from ..functions.text import requirement_name, strip
from .endpoints import split_lines

SPRING = tuple("spring-" + x for x in "batch beans boot cloud context core data kafka security web".split())
MANIFESTS = ("Cargo.toml", "build.gradle", "build.gradle.kts", "go.mod", "package.json", "pom.xml", "pyproject.toml", "requirements.txt", "settings.gradle")
PER_KIND = 40
GO_MODULES = 50
BUILD_FILES = 10

_STRINGS = "array<string>"


def _lines(content: Column) -> Column:
    return F.transform(split_lines(content), lambda l: strip(l))


def python_packages(content: Column) -> Column:
    return F.filter(F.transform(_lines(content), requirement_name), lambda n: n.isNotNull())


def node_packages(content: Column) -> Column:
    """Dependencies and development dependencies, sorted; empty for broken JSON."""
    names = lambda key: F.coalesce(F.map_keys(F.from_json(F.get_json_object(content, f"$.{key}"), "map<string,string>")), F.array().cast(_STRINGS))
    return F.array_sort(F.array_union(names("dependencies"), names("devDependencies")))


def go_modules(content: Column) -> Column:
    """Modules of single requires and of require blocks."""
    single = F.regexp_extract_all(content, F.lit(r"(?m)^\s*require\s+([^\s(]\S*)"), 1)
    block = F.array_join(F.regexp_extract_all(content, F.lit(r"(?s)\brequire\s*\(([^)]*)\)"), 1), "\n")
    inner = F.regexp_extract_all(block, F.lit(r"(?m)^\s*([^\s/]\S*)\s+v\S+"), 1)
    return F.slice(F.concat(single, inner), 1, GO_MODULES)


def rust_crates(content: Column) -> Column:
    """Keys of the [dependencies] table only."""
    state = F.aggregate(
        _lines(content),
        F.struct(F.lit(False).alias("on"), F.array().cast(_STRINGS).alias("found")),
        lambda s, l: F.struct(
            F.when(l.startswith("["), l == "[dependencies]").otherwise(s["on"]).alias("on"),
            F.when(s["on"] & l.rlike(r"^[^#\[][^=]*="), F.concat(s["found"], F.array(strip(F.substring_index(l, "=", 1))))).otherwise(s["found"]).alias("found"),
        ),
    )
    return state["found"]


def maven_packages(content: Column) -> Column:
    """group:artifact of each dependency and of the parent; namespaces don't matter."""
    tag = lambda block, name: F.regexp_extract(block, rf"<(?:\w+:)?{name}>\s*([^<\s]+)\s*<", 1)
    coordinate = lambda block: F.concat(tag(block, "groupId"), F.lit(":"), tag(block, "artifactId"))
    whole = lambda block: (tag(block, "groupId") != "") & (tag(block, "artifactId") != "")
    clean = F.regexp_replace(content, r"(?s)<!--.*?-->", "")
    inner = F.regexp_replace(clean, r"(?s)<exclusions>.*?</exclusions>", "")
    blocks = F.filter(F.regexp_extract_all(inner, F.lit(r"(?s)<(?:\w+:)?dependency>(.*?)</(?:\w+:)?dependency>"), 1), whole)
    parents = F.filter(F.regexp_extract_all(clean, F.lit(r"(?s)<(?:\w+:)?parent>(.*?)</(?:\w+:)?parent>"), 1), whole)
    return F.concat(F.transform(blocks, coordinate), F.transform(F.slice(parents, 1, 1), lambda b: F.concat(coordinate(b), F.lit(" (parent)"))))


def gradle_packages(content: Column) -> Column:
    """What dependency calls name, then other quoted coordinates."""
    calls = F.regexp_extract_all(content, F.lit(r"(?:api|compile|implementation|runtimeOnly|testImplementation)\s*[\s(][\"']([^\"']+)[\"']"), 1)
    part = r"[\w.-]+"
    others = F.regexp_extract_all(content, F.lit(rf"[\"']({part}:{part}(?::{part})?)[\"']"), 1)
    return F.concat(calls, F.array_except(others, calls))


def packages(manifests: DataFrame, root: str = "") -> DataFrame:
    """(ecosystem, package, path, ord) of all manifests; only build files count below the root."""
    name = base_name(F.col("path"))
    at_root = F.col("path") == F.concat(F.lit(root), name)
    of = lambda n, eco, found: F.when((name == n) & at_root, F.struct(F.lit(eco).alias("ecosystem"), found.alias("found")))
    c = F.col("content")
    java = lambda test, found: F.when(test, F.struct(F.lit("java_packages").alias("ecosystem"), found.alias("found")))
    each = F.coalesce(
        of("requirements.txt", "python_packages", python_packages(c)),
        of("package.json", "node_packages", node_packages(c)),
        of("go.mod", "go_modules", go_modules(c)),
        of("Cargo.toml", "rust_crates", rust_crates(c)),
        of("pyproject.toml", "other", F.array(F.lit("pyproject.toml detected"))),
        java(name == "pom.xml", maven_packages(c)),
        java(name.isin("build.gradle", "build.gradle.kts", "settings.gradle"), gradle_packages(c)),
    )
    kind = F.when(name == "pom.xml", F.lit("maven")).when(name.contains("gradle"), F.lit("gradle")).otherwise(name)
    nearest = Window.partitionBy("kind").orderBy(F.size(F.split("path", "/")), "path")
    rows = manifests.where(name.isin(*MANIFESTS)).withColumn("kind", kind).withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= BUILD_FILES)
    rows = rows.select("path", "kind", "n", each.alias("e")).where("e is not null")
    return rows.select("e.ecosystem", F.posexplode("e.found").alias("pos", "package"), "path", "kind", "n").select("ecosystem", "package", "path", F.struct(F.when(F.col("kind") == "maven", 0).otherwise(1).alias("k"), "n", "pos").alias("ord"))


def is_spring(package: Column) -> Column:
    low = F.lower(package)
    return F.exists(F.array(*[F.lit(x) for x in SPRING]), lambda k: F.contains(low, k))


def prioritised(rows: DataFrame, key: str, package: str, order: str, most: int = PER_KIND) -> DataFrame:
    """(key, package, spring, rank): distinct packages in order, Spring's first, at most so many of either."""
    first = rows.groupBy(F.col(key), F.col(package)).agg(F.min(order).alias("o")).withColumn("spring", is_spring(F.col(package)))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(key, "spring").orderBy("o", package)))
    return ranked.where(F.col("rank") <= most).select(key, package, "spring", "rank")
