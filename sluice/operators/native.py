"""Extractors that are line- or pattern-oriented and need no Python: SQL, Dockerfiles, shell
scripts, env files, Ruby requires. Each takes (path, content) or (path, line_no, line)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import context, let, strip

_REPLACE = r"(?:OR\s+REPLACE\s+)?"
#: Statement label -> words; statements are reported by label in this order, then by place.
STATEMENTS = [
    ("TABLE", r"CREATE\s+TABLE"),
    ("VIEW", r"CREATE\s+VIEW"),
    ("INDEX", r"CREATE\s+INDEX"),
    *[(x, rf"CREATE\s+{_REPLACE}{x}") for x in ("PROCEDURE", "FUNCTION", "TRIGGER")],
    *[(f"{verb}_TABLE", rf"{verb}\s+TABLE") for verb in ("ALTER", "DROP")],
    *[(x, x) for x in ("SELECT", "INSERT", "UPDATE", "DELETE")],
]
OBJECTS = ("PACKAGE", "PROCEDURE", "FUNCTION", "TRIGGER", "VIEW")
#: What speaks for PL/SQL, a point each.
PLSQL_SIGNS = [rf"CREATE\s+{_REPLACE}{x}" for x in OBJECTS] + ["DECLARE", "BEGIN", r"EXECUTE\s+IMMEDIATE", r"DBMS_\w+", r"UTL_\w+"]
PLSQL_SUFFIXES = r"(?i)\.(pkb|pks|pls|plsql)$"

INSTRUCTIONS = tuple(sorted("FROM RUN CMD ENTRYPOINT COPY ADD EXPOSE ENV ARG WORKDIR USER VOLUME LABEL HEALTHCHECK SHELL ONBUILD STOPSIGNAL".split()))

#: Tool -> label; those without a kind stand for themselves.
_KINDS = {"HTTP": "curl wget", "Kubernetes": "kubectl", "Database": "mysql psql"}
TOOLS = {t: f"{kind} ({t})" for kind, all_ in _KINDS.items() for t in all_.split()}
TOOLS |= {"aws": "AWS CLI", "az": "Azure CLI", "docker": "Docker CLI", "gcloud": "GCP CLI", "helm": "Helm CLI", "terraform": "Terraform CLI"}
TOOLS |= {"nc": "Netcat", "scp": "SCP", "ssh": "SSH"} | {t: t for t in ("git", "npm", "pip")}


def word(pattern: str) -> str:
    return rf"(?i)\b(?:{pattern})\b"


def plsql_score(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [text.rlike(word(p)).cast("int") for p in PLSQL_SIGNS])


def is_plsql(path: Column, text: Column) -> Column:
    """Two signs or more, dynamic SQL, or a suffix of PL/SQL."""
    return (plsql_score(text) >= 2) | text.rlike(word(r"EXECUTE\s+IMMEDIATE")) | path.rlike(PLSQL_SUFFIXES)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<match, line>> of a pattern: the text between matches tells the line."""
    ends = lambda texts: F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t) - F.length(F.replace(t, F.lit("\n"))))

    def rows(f: Column) -> Column:
        line = lambda i: 1 + ends(F.slice(f["between"], F.lit(1), i + 1)) + ends(F.slice(f["found"], F.lit(1), i))
        return F.transform(f["found"], lambda m, i: F.struct(m.alias("match"), line(i).cast("int").alias("line"), F.element_at(f["between"], (i + 2).cast("int")).alias("after")))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern).alias("between")), rows)


def sql_statements(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, label, signature, line, ord): one row a statement, by label and then by place."""
    text = F.col(content)

    def of(label: str, pattern: str) -> Column:
        return F.transform(_matches(text, word(pattern)), lambda m: F.struct(F.lit(label).alias("label"), F.substring(m["match"], 1, 200).alias("signature"), m["line"].alias("line")))

    each = F.array(*[of(label, p) for label, p in STATEMENTS])
    rows = files.select(key, F.posexplode(F.flatten(each)).alias("ord", "s"))
    return rows.select(key, "s.label", "s.signature", "s.line", "ord")


def plsql_objects(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, type, name, snippet, line): packages, routines, triggers, views and DECLARE blocks."""
    text = F.col(content)

    def of(kind: str, pattern: str) -> Column:
        def row(m: Column, i: Column) -> Column:
            snippet = strip(F.element_at(F.split(F.substring(F.concat(m["match"], m["after"]), 1, 120), "\n"), 1))
            name = F.regexp_extract(snippet, rf"(?i)(?:{'|'.join(OBJECTS)})\s+(\w+)", 1)
            return F.struct(F.lit(kind).alias("type"), F.when(name == "", F.lit(kind)).otherwise(name).alias("name"), snippet.alias("snippet"), m["line"].alias("line"))

        return F.transform(_matches(text, word(pattern)), row)

    each = [of(x, rf"CREATE\s+{_REPLACE}{x}") for x in OBJECTS] + [of("PL/SQL_BLOCK", "DECLARE")]
    return files.select(key, F.inline(F.flatten(F.array(*each))))


def docker_instructions(line_table: DataFrame, key: str = "path") -> DataFrame:
    """(key, line_no, instruction, signature)."""
    line = strip(F.col("line"))
    op = F.upper(F.regexp_extract(line, r"^(\S+)", 1))
    return line_table.select(key, "line_no", op.alias("instruction"), line.alias("signature")).where(F.col("instruction").isin(*INSTRUCTIONS))


def shell_calls(line_table: DataFrame, key: str = "path") -> DataFrame:
    """(key, pattern, line, context): each tool that a line calls."""
    labels = F.filter(F.array(*[F.when(F.col("line").rlike(rf"\b{t}\b"), F.lit(label)) for t, label in TOOLS.items()]), lambda x: x.isNotNull())
    return line_table.select(key, F.explode(labels).alias("pattern"), F.col("line_no").alias("line"), context(F.col("line"), 120).alias("context"))


def shell_summary(calls: DataFrame, key: str = "path") -> DataFrame:
    """(key, tools): the distinct tools of a script in order."""
    return calls.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("pattern")), ", ").alias("tools"))


def shell_imports(line_table: DataFrame, key: str = "path") -> DataFrame:
    line = strip(F.col("line"))
    return line_table.select(key, "line_no", line.alias("stmt")).where(F.col("stmt").startswith("source ") | F.col("stmt").startswith(". "))


def env_exports(line_table: DataFrame, key: str = "path") -> DataFrame:
    """(key, line_no, export): what stands before ``=``, or the whole line."""
    line = strip(F.col("line"))
    return line_table.select(key, "line_no", F.substring_index(line, "=", 1).alias("export"), line.alias("l")).where("l <> '' and not startswith(l, '#')").drop("l")


def ruby_requires(line_table: DataFrame, key: str = "path") -> DataFrame:
    line = strip(F.col("line"))
    return line_table.select(key, "line_no", line.alias("stmt")).where(F.col("stmt").rlike("^require(_relative)? "))


def brace_depth(line_table: DataFrame, key: str = "path") -> DataFrame:
    """(key, line_no, depth): open braces after each line."""
    count = lambda c: F.length("line") - F.length(F.translate(F.col("line"), c, ""))
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return line_table.select(key, "line_no", F.sum(count("{") - count("}")).over(so_far).alias("depth"))
