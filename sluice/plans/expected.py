"""What the source templates declare, written down by hand, and SQL that says so.

``parsers.SAMPLES`` has a file for each language with places for a number (@K), a type's name
(@C) and a function's (@F). Here are the facts of each of these files, and a plain renderer of
its document; both give texts with the same places, which SQL fills from the table. Nothing of
the parsers or the renderer under test is used.
"""

from __future__ import annotations

import json


def _function(name, signature, start, end, parent=None, doc=None, decorators=(), calls=(), method=None):
    return {"name": name, "signature": signature, "docstring": doc, "decorators": list(decorators), "is_method": parent is not None if method is None else method, "parent_class": parent, "line_start": start, "line_end": end, "internal_calls": list(calls)}


def _class(name, start, end, methods=(), doc=None, bases=(), decorators=()):
    return {"name": name, "docstring": doc, "bases": list(bases), "decorators": list(decorators), "methods": list(methods), "line_start": start, "line_end": end}


def _facts(language, imports=(), exports=(), classes=(), functions=(), calls=(), urls=(), endpoints=(), doc=None):
    return {"language": language, "doc": doc, "imports": list(imports), "exports": list(exports), "classes": list(classes), "functions": list(functions), "calls": [dict(zip(("pattern", "line", "context"), c)) for c in calls], "urls": urls, "endpoints": endpoints}


_SITE = "https://host@K.example"
FACTS = {
    ".py": _facts(
        "python", ["import os", "from pkg import @F"], ["run_@F", "@C"], [_class("@C", 6, 10, [_function("@F", "def @F(self, a: int=1) -> int", 9, 10, "@C", decorators=["@property"])], "A @C.", ["Base"], ["@decorated"])],
        [_function("run_@F", "def run_@F(x)", 13, 15, doc="Runs.", calls=["@C", "helper"])], [("HTTP (requests)", 10, f'requests.get("{_SITE}/x")')], [(f"{_SITE}/x", 10, f'return requests.get("{_SITE}/x")')], doc="Module @K.",
    ),
    ".js": _facts(
        "javascript", ['import a from "./m@K"', 'require("fs")'], ["@C"], [_class("@C", 4, 11, [_function("constructor", "function constructor(u)", 5, 7, "@C"), _function("@F", "function @F(x)", 8, 10, "@C")], bases=["Base"])],
        [_function("helper@K", "function helper@K(y)", 12, 14)], [("HTTP (fetch)", 9, f'fetch("{_SITE}/" + x)')], [(f"{_SITE}/", 9, f'return fetch("{_SITE}/" + x);')], doc="Client @K",
    ),
    ".java": _facts("java", ["import java.util.List;"], ["@C"], [_class("@C", 3, 11, [_function("@F", "@F(int a)", 5, 5, "@C")])]),
    ".yaml": _facts(
        "kubernetes", ["apiVersion: apps/v1", "kind: Deployment", "image: repo/@F:@K"],
        ["K8s/Deployment", "apiVersion: apps/v1", "kind: Deployment", "metadata: name: @F-@K", "name: @F-@K", 'spec: containers:\n    - image: "repo/@F:@K"', 'containers: - image: "repo/@F:@K"', "image: repo/@F:@K"],
        [_class("Deployment/@F-@K", 1, 8, doc="Kubernetes Deployment resource")], doc="Kubernetes Deployment manifest (apiVersion: apps/v1)\nResource name: @F-@K",
    ),
    ".tf": _facts(
        "terraform", ['module "net@K"'], ["resource.vm", "disk", "module.net@K"], [_class("resource.vm", 1, 5, doc="resource block"), _class("disk", 2, 4, doc="disk block"), _class("module.net@K", 6, 8, doc="module block")],
        [_function("resource", 'resource "vm" "@F"', 1, 5), _function("disk", "disk", 2, 4), _function("module", 'module "net@K"', 6, 8)], doc="Infrastructure as Code (terraform): resource.vm, disk, module.net@K",
    ),
    ".go": _facts("go", ['"fmt"'], ["@C", "@F"], [_class("@C", 7, 9, [_function("Get@K", "func Get@K(a int) int", 11, 13, "@C")])], [_function("@F", "func @F()", 15, 17)]),
    ".rs": _facts("rust", ["use std::io;"], ["@C"], [_class("@C", 3, 5, [_function("@F", "fn @F(&self) -> u32", 8, 10, "@C")])]),
    ".cs": _facts("csharp", ["using System;"], ["@C"], [_class("@C", 3, 9, [_function("@C", "@C(int n)", 4, 5, "@C"), _function("@F", "@F(string s): int", 6, 8, "@C")])]),
    ".sql": _facts("sql", exports=["TABLE", "SELECT"], functions=[_function("TABLE", "CREATE TABLE", 1, 1), _function("SELECT", "SELECT", 2, 2)]),
    ".dockerfile": _facts("dockerfile", ["base:@K"], ["FROM", "RUN", "COPY"], functions=[_function("FROM", "FROM base:@K", 1, 1), _function("RUN", "RUN make @F", 2, 2), _function("COPY", "COPY . /app", 3, 3)], doc="Dockerfile instructions: FROM, RUN, COPY"),
    ".sh": _facts("bash", ["source ./env"], ["@F"], functions=[_function("@F", "@F()", 3, 5)], calls=[("HTTP (curl)", 4, f'curl "{_SITE}"')], urls=[(_SITE, 4, f'curl "{_SITE}"')], doc="Shell script using: HTTP (curl)"),
    ".properties": _facts("env", exports=["DB_HOST", "name.@F"], endpoints=[("env", "db@K.internal", None, None, None, None, 2, "DB_HOST=db@K.internal")]),
    ".rb": _facts("ruby", ["require 'json'"], ["@C", "top@K"], [_class("@C", 2, 6, [_function("@F", "@F(a)", 3, 5, "@C")])], [_function("top@K", "top@K()", 7, 8, method=True)]),
    ".c": _facts("c", ["#include <stdio.h>"], ["@C", "@F"], [_class("@C", 2, 4)], [_function("@F", "@F(int a)", 5, 7)]),
    ".cpp": _facts("cpp", ["#include <vector>"], ["@C", "run@K"], [_class("@C", 2, 7, [_function("@F", "@F()", 4, 6, "@C")])], [_function("run@K", "run@K(int a)", 8, 9)]),
    ".php": _facts("php", ["use A\\B;"], ["@C", "run@K"], [_class("@C", 3, 7, [_function("@F", "@F($a)", 4, 6, "@C")])], [_function("run@K", "run@K()", 8, 9)]),
    ".kt": _facts("kotlin", ["import a.b"], ["@C"], [_class("@C", 2, 6, [_function("@F", "@F(a: Int): Int", 3, 5, "@C")])]),
    ".scala": _facts("scala", ["import a.b"], ["@C"], [_class("@C", 2, 6, [_function("@F", "@F(a: Int): Int", 3, 5, "@C")])]),
    ".swift": _facts("swift", ["import Foundation"], ["@C"], [_class("@C", 2, 6, [_function("@F", "@F(a: Int): [Int]", 3, 5, "@C")])]),
}


# ---------------------------------------------------------------- a plain renderer


def _function_text(f: dict, level: str) -> str:
    out = f"{level} `{f['name']}`\n\n```\n{f['signature']}\n```\n\n"
    if f["decorators"]:
        out += f"**Decorators:** {', '.join(f['decorators'])}\n\n"
    if f["docstring"]:
        out += f["docstring"] + "\n\n"
    if f["internal_calls"]:
        out += f"**Internal calls:** {', '.join(f['internal_calls'])}\n\n"
    return out + f"*Lines {f['line_start']}–{f['line_end']}*\n\n"


def _class_text(c: dict) -> str:
    out = f"### {c['name']}\n\n"
    if c["bases"]:
        out += f"**Bases:** {', '.join(c['bases'])}\n\n"
    if c["decorators"]:
        out += f"**Decorators:** {', '.join(c['decorators'])}\n\n"
    if c["docstring"]:
        out += c["docstring"] + "\n\n"
    out += f"*Lines {c['line_start']}–{c['line_end']}*\n\n"
    return out + ("#### Methods\n\n" + "".join(_function_text(m, "#####") for m in c["methods"]) if c["methods"] else "")


def document(path: str, x: dict) -> str:
    quote = lambda v: json.dumps(v, ensure_ascii=False)
    fields = ("type", "host", "port", "user", "schema", "database")
    out = f"---\nfilepath: {path}\nlanguage: {x['language']}\n"
    for part in ("imports", "exports"):
        out += f"{part}:\n" + "".join(f"  - {quote(v)}\n" for v in x[part])
    if x["calls"]:
        out += "external_calls:\n" + "".join(f"  - pattern: {quote(c['pattern'])}\n    line: {c['line']}\n" for c in x["calls"])
    if x["urls"]:
        out += "external_urls:\n" + "".join(f"  - url: {quote(u)}\n    line: {n}\n" for u, n, _ in x["urls"])
    if x["endpoints"]:
        out += "database_endpoints:\n"
        for *values, line, _ in x["endpoints"]:
            out += "  - " + "    ".join(f"{f}: {quote(v)}\n" for f, v in zip(fields, values)) + f"    line: {line}\n"
    out += f"---\n\n# File: `{path}`\n\n## Overview\n\n{x['doc'] or '*No module-level documentation found.*'}\n\n"
    if x["imports"]:
        out += "## Imports\n\n" + "".join(f"- `{v}`\n" for v in x["imports"]) + "\n"
    if x["classes"]:
        out += "## Classes\n\n" + "".join(map(_class_text, x["classes"]))
    if x["functions"]:
        out += "## Functions\n\n" + "".join(_function_text(f, "###") for f in x["functions"])
    tables = [
        ("External Service Calls", ("Pattern", "Line", "Context"), [(c["pattern"], c["line"], f"`{c['context']}`") for c in x["calls"]]),
        ("External URLs", ("URL", "Line", "Context"), [(u, n, f"`{c}`") for u, n, c in x["urls"]]),
        ("Database & Connection Endpoints", ("Type", "Host", "Port", "User", "Schema", "Database", "Line", "Source"), [(*e[:-1], f"`{e[-1]}`") for e in x["endpoints"]]),
    ]
    for title, heads, rows in tables:
        if rows:
            lines = [heads, ["-" * (len(h) + 2) for h in heads], *rows]
            cells = [[str("—" if v is None else v) for v in row] for row in lines]
            out += f"## {title}\n\n" + "".join(f"|{'|'.join(row)}|\n" if k == 1 else f"| {' | '.join(row)} |\n" for k, row in enumerate(cells)) + "\n"
    return out


# ---------------------------------------------------------------- SQL

_PARTS = "(select p_partkey::varchar as k, upper(left(replace(p_name, ' ', ''), 1)) || lower(substr(replace(p_name, ' ', ''), 2)) as c, concat('f_', split_part(p_name, ' ', 1)) as f from part)"


def _filled(text: str | None) -> str:
    return "null" if text is None else "replace(replace(replace('" + text.replace("'", "''") + "', '@K', k), '@C', c), '@F', f)"


def _json(items: list) -> str:
    given = lambda v: {k: given(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else [given(x) for x in v] if isinstance(v, list) else v
    return json.dumps(given(items), separators=(",", ":"), ensure_ascii=False)


def symbols_sql(suffix: str) -> str:
    x = FACTS[suffix]
    lists = ", ".join(f"{_filled(_json(x[c]))} as {name}" for name, c in (("imports", "imports"), ("exports", "exports"), ("classes", "classes"), ("functions", "functions"), ("external_calls", "calls")))
    return f"select {_filled('src/m@K' + suffix)} as path, '{x['language']}' as language, {_filled(x['doc'])} as module_docstring, {lists}, null as error from {_PARTS}"


def documents_sql() -> str:
    each = " union all ".join(f"select {_filled('src/m@K' + s)} as path, {_filled('src_m@K' + s.replace('.', '_') + '.md')} as kb_name, {_filled(document('src/m@K' + s, x))} as markdown from p" for s, x in FACTS.items())
    return f"with p as {_PARTS} {each}"
