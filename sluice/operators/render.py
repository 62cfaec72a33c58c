"""Markdown of parsed files and of a project.

A file's document is one built-in expression over its nested row: no Python worker, no shuffle
but the one that keeps names apart. The project's index is put together from small aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import document_name
from .project import renamed_documents

DASH = "—"
#: Of a path with its name; of the names that may be broadcast.
NAME_BYTES, BROADCAST_BYTES = 500, 8 << 20
FIELDS = ("type", "host", "port", "user", "schema", "database")


def _text(*parts: Column | str) -> Column:
    """Parts joined to one string; a null part is empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _each(items: Column, line) -> Column:
    return F.array_join(F.transform(items, line), "")


def _some(items: Column, *parts: Column | str) -> Column:
    return F.when(F.size(items) > 0, _text(*parts)).otherwise("")


def _given(value: Column, *parts: Column | str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", _text(*parts)).otherwise("")


def quoted(c: Column) -> Column:
    """A JSON string, or null."""
    inner = F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(c.isNull(), F.lit("null")).otherwise(inner)


def _type(e: Column, f: str) -> Column:
    return e["connection_type" if f == "type" else f]


def front_matter(links: bool = False) -> Column:
    """Facts in front of the text; optional lists are left out when they are empty."""
    names = lambda title, items: _text(f"{title}:\n", _each(items, lambda x: _text("  - ", quoted(x), "\n")))
    c = F.col
    parts: list[Column | str] = ["---\nfilepath: ", c("path"), "\nlanguage: ", c("language"), "\n", names("imports", c("imports")), names("exports", c("exports"))]
    if links:
        parts.append(_some(c("internal_dependencies"), names("internal_dependencies", c("internal_dependencies"))))
    parts.append(_some(c("external_calls"), "external_calls:\n", _each(c("external_calls"), lambda x: _text("  - pattern: ", quoted(x["pattern"]), "\n    line: ", x["line"], "\n"))))
    parts.append(_some(c("external_urls"), "external_urls:\n", _each(c("external_urls"), lambda x: _text("  - url: ", quoted(x["url"]), "\n    line: ", x["line"], "\n"))))
    fields = lambda e: _text(*[p for n, f in enumerate(FIELDS) for p in ("  - " if n == 0 else "    ", f"{f}: ", quoted(_type(e, f)), "\n")], "    line: ", e["line"], "\n")
    parts.append(_some(c("database_endpoints"), "database_endpoints:\n", _each(c("database_endpoints"), fields)))
    return _text(*parts, "---\n")


def _function(level: str):
    def one(f: Column) -> Column:
        lines = _text("*Lines ", f["line_start"], "–", f["line_end"], "*\n\n")
        more = [_some(f["decorators"], "**Decorators:** ", F.array_join(f["decorators"], ", "), "\n\n"), _given(f["docstring"], f["docstring"], "\n\n"), _some(f["internal_calls"], "**Internal calls:** ", F.array_join(f["internal_calls"], ", "), "\n\n")]
        return _text(f"{level} `", f["name"], "`\n\n```\n", f["signature"], "\n```\n\n", *more, lines)

    return one


def _class(c: Column) -> Column:
    head = [_some(c["bases"], "**Bases:** ", F.array_join(c["bases"], ", "), "\n\n"), _some(c["decorators"], "**Decorators:** ", F.array_join(c["decorators"], ", "), "\n\n"), _given(c["docstring"], c["docstring"], "\n\n")]
    return _text("### ", c["name"], "\n\n", *head, "*Lines ", c["line_start"], "–", c["line_end"], "*\n\n", _some(c["methods"], "#### Methods\n\n", _each(c["methods"], _function("#####"))))


def _table(title: str, items: Column, heads: tuple[str, ...], cells) -> Column:
    head = f"## {title}\n\n| {' | '.join(heads)} |\n|{'|'.join('-' * (len(h) + 2) for h in heads)}|\n"
    return _some(items, head, _each(items, lambda x: _text("| ", F.concat_ws(" | ", *[F.coalesce(v.cast("string"), F.lit(DASH)) for v in cells(x)]), " |\n")), "\n")


def _code(c: Column) -> Column:
    return F.concat(F.lit("`"), F.coalesce(c, F.lit("")), F.lit("`"))


def module_text(links: bool = False) -> Column:
    c = F.col
    overview = F.when(F.coalesce(c("module_docstring"), F.lit("")) != "", c("module_docstring")).otherwise("*No module-level documentation found.*")
    sections = [
        _some(c("imports"), "## Imports\n\n", _each(c("imports"), lambda x: _text("- `", x, "`\n")), "\n"),
        _some(c("classes"), "## Classes\n\n", _each(c("classes"), _class)),
        _some(c("functions"), "## Functions\n\n", _each(c("functions"), _function("###"))),
        _table("External Service Calls", c("external_calls"), ("Pattern", "Line", "Context"), lambda x: (x["pattern"], x["line"], _code(x["context"]))),
        _table("External URLs", c("external_urls"), ("URL", "Line", "Context"), lambda x: (x["url"], x["line"], _code(x["context"]))),
        _table("Database & Connection Endpoints", c("database_endpoints"), ("Type", "Host", "Port", "User", "Schema", "Database", "Line", "Source"), lambda e: (*[_type(e, f) for f in FIELDS], e["line"], _code(F.coalesce(e["raw_redacted"], e["context"])))),
    ]
    return _text(front_matter(links), "\n# File: `", c("path"), "`\n\n## Overview\n\n", overview, "\n\n", *sections)


def modules(parsed: DataFrame) -> DataFrame:
    """(path, kb_name, markdown): the document of each parsed file; names don't clash.

    Names follow from paths, but for those of a clash: they are counted, and only they are joined. A small
    file of paths can give many large documents, so Spark's estimate of a side isn't asked.
    """
    text = parsed.where("path is not null").select("path", document_name(F.col("path")).alias("kb_name"), module_text("internal_dependencies" in parsed.columns).alias("markdown"))
    other = renamed_documents(parsed)
    n = other.count()
    if not n:
        return text
    other = other.withColumnRenamed("kb_name", "other").hint("broadcast" if n * NAME_BYTES <= BROADCAST_BYTES else "merge")
    return text.join(other, "path", "left").select("path", F.coalesce("other", "kb_name").alias("kb_name"), "markdown")


def _rows(heads: tuple[str, ...], rows: list[tuple]) -> list[str]:
    show = lambda v: DASH if v is None or v == "" else str(v)
    return [f"| {' | '.join(heads)} |", f"|{'|'.join('-' * (len(h) + 2) for h in heads)}|", *(f"| {' | '.join(map(show, r))} |" for r in rows)]


STACK_TITLES = {"python_packages": "Python Dependencies", "node_packages": "Node.js Dependencies", "go_modules": "Go Modules", "rust_crates": "Rust Crates", "java_packages": "Java / Spring Dependencies"}


def project_index(root: str, stack: dict[str, list[str]], languages: list[tuple], edges: list[tuple], urls: list[tuple], endpoints: list[tuple], files: list[tuple]) -> str:
    """The index of a project from its aggregates, each as rows in order."""
    name = root.rstrip("/").rpartition("/")[2]
    out = ["---", "title: Project Index", f"root: {root}", f"file_count: {len(files)}", "---", "", f"# Project Index: {name}", "", f"**Root:** `{root}`  ", f"**Parsed files:** {len(files)}", "", "## Tech Stack", ""]
    for key, title in STACK_TITLES.items():
        if stack.get(key):
            out += [f"### {title}", "", *(f"- {p}" for p in stack[key]), ""]
    out += ["## Files by Language", "", *_rows(("Language", "Count"), languages), "", "## Module Dependency Graph", ""]
    out += [*(f"- `{a}` → `{b}`" for a, b in edges)] or ["*No internal module dependencies detected.*"]
    out += ["", "## External URLs (Project-wide)", ""]
    out += _rows(("URL", "Found In", "Line"), [(u, f"`{p}`", n) for u, p, n in urls]) if urls else ["*No external URLs detected.*"]
    out += ["", "## Database Endpoints (Project-wide)", ""]
    heads = (*(f.title() for f in FIELDS), "File", "Line")
    out += _rows(heads, [(*e[:6], f"`{e[6]}`", e[7]) for e in endpoints]) if endpoints else ["*No database connection endpoints detected.*"]
    out += ["", "## File Index", "", *_rows(("File", "Language", "Classes", "Functions", "KB Document"), [(f"`{p}`", lang, c, f, f"[{k}](modules/{k})") for p, lang, c, f, k in files]), ""]
    return "\n".join(out)
