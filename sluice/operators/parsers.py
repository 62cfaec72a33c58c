"""Symbols of whole source files, by language.

Python files are read by the standard library's own parser. For the languages with braces there
is no grammar here: comments and strings are masked, brackets are paired, and declarations are
looked for in what is left; such results are approximations. Parsers run in Arrow batches, one
call a file, and return one nested Arrow value; everything after them is a built-in expression.

A file that a parser can't read has its ``error`` set and no symbols; no file fails a batch.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.languages import detect_language
from ..functions.text import redact_secrets
from ..schemas import SYMBOLS
from .endpoints import text_endpoints, text_urls
from .native import INSTRUCTIONS, OBJECTS, PLSQL_SIGNS, STATEMENTS, TOOLS, _REPLACE, word

#: Languages whose texts are not searched for endpoints.
NOT_SEARCHED = ("dockerfile", "java", "plsql", "sql")


def symbols(language: str, **found) -> dict:
    return {"language": language, "module_docstring": None, "imports": [], "exports": [], "classes": [], "functions": [], "external_calls": [], "error": None} | found


def function(name: str, signature: str, start: int, end: int, docstring: str | None = None, decorators=(), parent: str | None = None, method: bool | None = None, calls=()) -> dict:
    return {"name": name, "signature": signature, "docstring": docstring, "decorators": list(decorators), "is_method": parent is not None if method is None else method, "parent_class": parent, "line_start": start, "line_end": end, "internal_calls": list(calls)}


def klass(name: str, start: int, end: int, docstring: str | None = None, bases=(), decorators=()) -> dict:
    return {"name": name, "docstring": docstring, "bases": list(bases), "decorators": list(decorators), "methods": [], "line_start": start, "line_end": end}


class Calls:
    """External calls, each label once a line, with the context cut."""

    def __init__(self, labels: dict[str, str], size: int = 120):
        self.labels, self.size = [(label, re.compile(p)) for label, p in labels.items()], size

    def first(self, called: str) -> str | None:
        return next((label for label, p in self.labels if p.search(called)), None)

    def rows(self, found) -> list[dict]:
        """found: (label, line, context), labels may be None."""
        once = {}
        for label, line, context in found:
            if label:
                once.setdefault((line, label), {"pattern": label, "line": line, "context": context.strip()[: self.size]})
        return list(once.values())


# ---------------------------------------------------------------- Python

_VERBS = "delete|get|head|patch|post|put|request"
_DB, _HTTP = "Database ({})".format, "HTTP ({})".format
PYTHON_CALLS = Calls({
    _HTTP("requests"): rf"\brequests\.(?:{_VERBS})\b", _HTTP("httpx"): rf"\bhttpx\.(?:{_VERBS}|AsyncClient)\b", _HTTP("urllib"): r"\burllib\.(?:urlopen|request)\b", _HTTP("aiohttp"): r"\baiohttp\.(?:request|ClientSession)\b",
    _DB("cursor.execute"): r"\bcursor\.execute\b", _DB("ORM session"): r"\bsession\.(?:commit|execute|query)\b", _DB("SQLAlchemy"): r"\b(?:engine|Session)\.(?:execute|query)\b", _DB("MongoDB"): r"\bMongoClient\b", _DB("Redis"): r"\bredis\.(?:Strict)?Redis\b",
    "AWS SDK (boto3)": r"\bboto3\.(?:client|resource)\b", "API (OpenAI SDK)": r"\bopenai\.\w+", "API (Anthropic SDK)": r"\banthropic\.\w+",
})


def parse_python(path: str, text: str) -> dict:
    """Classes anywhere, functions that aren't in functions, module-level imports, calls; a syntax error leaves lines."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return _python_lines(text) | {"error": type(e).__name__}
    piece = lambda node: ast.get_source_segment(text, node) or ""
    out, known = symbols("python", module_docstring=ast.get_docstring(tree, clean=False)), {}

    def signature(node) -> str:
        returns = f" -> {piece(node.returns)}" if node.returns else ""
        return f"def {node.name}({ast.unparse(node.args)}){returns}"

    def visit(node, inside: str | None, hidden: bool = False) -> None:
        """``hidden``: in a function, where only classes and what they hold count."""
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                bases = [piece(b) for b in child.bases if isinstance(b, ast.Name | ast.Attribute | ast.Call)]
                known[child.name] = klass(child.name, child.lineno, child.end_lineno, ast.get_docstring(child, clean=False), bases, ["@" + piece(d) for d in child.decorator_list])
                out["classes"].append(known[child.name])
                visit(child, child.name)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                if not hidden:
                    calls = sorted({c.func.id for c in ast.walk(child) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name)})
                    f = function(child.name, signature(child), child.lineno, child.end_lineno, ast.get_docstring(child, clean=False), ["@" + piece(d) for d in child.decorator_list], inside, calls=calls)
                    (known[inside]["methods"] if inside else out["functions"]).append(f)
                visit(child, None, True)
            else:
                visit(child, inside, hidden)

    visit(tree, None)
    out["imports"] = [piece(n) for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom)]
    out["exports"] = [f["name"] for f in out["functions"]] + [c["name"] for c in out["classes"]]
    called = sorted((n for n in ast.walk(tree) if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.col_offset))
    out["external_calls"] = PYTHON_CALLS.rows((PYTHON_CALLS.first(piece(n.func)), n.lineno, piece(n)) for n in called)
    return out


def _python_lines(text: str) -> dict:
    out = symbols("python")
    for n, line in enumerate(text.splitlines(), 1):
        if m := re.match(r"(?:async\s+)?def\s+(\w+)\s*(\([^:]*\))", line):
            out["functions"].append(function(m[1], f"def {m[1]}{m[2]}", n, n))
        elif m := re.match(r"class\s+(\w+)", line):
            out["classes"].append(klass(m[1], n, n))
        elif re.match(r"(?:import|from)\s+\S", line):
            out["imports"].append(line.strip())
    out["exports"] = [x["name"] for kind in ("functions", "classes") for x in out[kind]]
    out["external_calls"] = PYTHON_CALLS.rows((PYTHON_CALLS.first(line), n, line) for n, line in enumerate(text.splitlines(), 1) if "(" in line)
    return out


# ---------------------------------------------------------------- languages with braces

_MASKED = {
    "c": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
    "rust": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S),
    "script": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
    "hash": re.compile(r"#[^\n]*|//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"", re.S),
}
_BLANK = re.compile(r"[^\n]")


class Source:
    """A text, the same with comments and strings blanked, its lines and its pairs of braces."""

    def __init__(self, text: str, style: str):
        self.text, self.style = text, style
        self.mask = _MASKED[style].sub(lambda m: _BLANK.sub(" ", m[0]), text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.close, stack = {}, []
        for m in re.finditer(r"[{}]", self.mask):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def block(self, at: int, stop: str = ";") -> tuple[int, int] | None:
        """The braces that open after ``at`` before any sign of ``stop``; to the end where none closes."""
        m = re.compile(rf"[{{}}{stop}]").search(self.mask, at)
        if not m or m[0] != "{":
            return None
        return m.start(), self.close.get(m.start(), len(self.text))

    def arguments(self, at: int) -> str:
        """The text of the parentheses that open at ``at``."""
        depth = 0
        for m in re.compile(r"[()]").finditer(self.mask, at):
            depth += 1 if m[0] == "(" else -1
            if not depth:
                return self.text[at : m.end()]
        return self.text[at:]

    def comment(self) -> str | None:
        """The comment the text starts with, without its signs."""
        signs = "//|#" if self.style == "hash" else "//"
        m = re.match(rf"\s*(?:/\*.*?\*/|(?:[ \t]*(?:{signs})[^\n]*\n?)+)", self.text, re.S)
        if not m:
            return None
        lines = [re.sub(r"^\s*(?:/\*+|\*+/|\*(?!/)|//+!?|#+)?\s?|\s*\*+/\s*$", "", x) for x in m[0].strip().splitlines()]
        return "\n".join(lines).strip() or None


@dataclass(frozen=True)
class Profile:
    """What declares things in a language; group ``name``, and ``params`` where a function's parentheses open."""

    imports: str | None = None
    classes: str | None = None
    functions: str | None = None
    #: the type a method belongs to, where it is named outside of a class: group ``of``
    owners: str | None = None
    style: str = "c"
    #: functions and methods are told apart by the class around them only
    all_methods: bool = False
    #: signs that end a declaration without braces
    stop: str = ";"
    lead: str = ""
    #: the type of what a function returns, in what follows the parentheses; it may also be group ``returns``
    result: str | None = None
    #: what stands between a signature and that type
    gives: str = ": "
    not_functions: frozenset = frozenset("catch do else elif for if return sizeof switch throw while new".split())


_WORDS = r"(?:[\w@]+[ \t]+)*?"
_AT = r"(?:^|(?<=[{};]))[ \t]*"
_TYPED = r"^[ \t]*(?:[\w:<>,\[\]*&?.]+[ \t*&]+)+(?P<name>~?[A-Za-z_]\w*(?:::~?\w+)?)[ \t]*(?P<params>\()"
_COLON = r"[ \t]*:[ \t]*([^={}\n]+?)[ \t]*(?:[={}]|$)"
PROFILES = {
    "go": Profile(r"^[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?\"(?P<name>[^\"\n]+)\"[ \t]*$", r"^type[ \t]+(?P<name>\w+)(?:\[[^\]]*\])?[ \t]+(?:struct|interface)", r"^func[ \t]+(?:\([^)]*\)[ \t]*)?(?P<name>\w+)(?:\[[^\]]*\])?(?P<params>\()", r"^func[ \t]+\([^)]*?\*?(?P<of>\w+)(?:\[[^\]]*\])?\)", lead="func ", stop=";\n", result=r"[ \t]*([^{\n]*?)[ \t]*(?:\{|$)", gives=" "),
    "rust": Profile(r"^[ \t]*(?P<name>(?:pub[ \t]+)?use[ \t][^;]+;)", r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:struct|enum|trait)[ \t]+(?P<name>\w+)", _AT + _WORDS + r"(?:pub\([^)]*\)[ \t]+)?fn[ \t]+(?P<name>\w+)(?:<[^>\n]*>)?[ \t]*(?P<params>\()", r"^[ \t]*impl(?:<[^>\n]*>)?[ \t]+(?:[\w:<>]+[ \t]+for[ \t]+)?(?P<of>\w+)", style="rust", all_methods=True, lead="fn ", result=r"\s*->\s*([^{;]+?)\s*(?:\bwhere\b[^{;]*)?(?:[{;]|$)", gives=" -> "),
    "cpp": Profile(r"^[ \t]*(?P<name>#[ \t]*include[^\n]+)", r"^[ \t]*(?:template[ \t]*<[^>\n]*>\s*)?(?:class|struct)[ \t]+(?P<name>\w+)", _TYPED),
    "c": Profile(r"^[ \t]*(?P<name>#[ \t]*include[^\n]+)", r"^[ \t]*(?:typedef[ \t]+)?struct[ \t]+(?P<name>\w+)", _TYPED, not_functions=frozenset("do else for if return sizeof switch while".split())),
    "csharp": Profile(r"^[ \t]*(?P<name>(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?[\w.= ]+;)", r"^[ \t]*" + _WORDS + r"(?:class|struct|interface)[ \t]+(?P<name>\w+)", _AT + r"(?:(?:public|private|protected|internal|static|async|override|virtual|abstract|sealed|partial)[ \t]+)+(?:(?P<returns>[\w<>\[\],.?]+)[ \t]+)?(?P<name>\w+)(?:<[^>\n]*>)?[ \t]*(?P<params>\()", all_methods=True),
    "php": Profile(r"^[ \t]*(?P<name>use[ \t]+[^;(]+;)", r"^[ \t]*" + _WORDS + r"(?:class|interface|trait)[ \t]+(?P<name>\w+)", _AT + _WORDS + r"function[ \t]+&?(?P<name>\w+)[ \t]*(?P<params>\()"),
    "kotlin": Profile(r"^[ \t]*(?P<name>import[ \t]+[\w.*]+(?:[ \t]+as[ \t]+\w+)?)", r"^[ \t]*" + _WORDS + r"(?:class|interface|object)[ \t]+(?P<name>\w+)", _AT + _WORDS + r"fun[ \t]+(?:<[^>\n]*>[ \t]*)?(?:\w+\.)?(?P<name>\w+)[ \t]*(?P<params>\()", all_methods=True, stop=";\n", result=_COLON),
    "scala": Profile(r"^[ \t]*(?P<name>import[ \t]+[^\n;]+)", r"^[ \t]*" + _WORDS + r"(?:class|object|trait)[ \t]+(?P<name>\w+)", _AT + _WORDS + r"def[ \t]+(?P<name>\w+)(?:\[[^\]]*\])?[ \t]*(?P<params>\(?)", stop=";\n", result=_COLON),
    "swift": Profile(r"^[ \t]*(?P<name>(?:@\w+[ \t]+)?import[ \t]+[\w.]+)", r"^[ \t]*" + _WORDS + r"(?:class|struct|enum|protocol)[ \t]+(?P<name>\w+)", _AT + _WORDS + r"(?:func[ \t]+(?P<name>\w+)|(?P<init>init)\??)(?:<[^>\n]*>)?[ \t]*(?P<params>\()", all_methods=True, stop=";\n", result=r"[^{}\n]*?->[ \t]*([^{}\n]+?)[ \t]*(?:\bwhere\b[^{\n]*)?(?:[{}]|$)"),
}


def _spanned(source: Source, pattern: str | None, group: str, stop: str = ";") -> list[tuple[str, int, int, re.Match]]:
    """(name, start, end, match) of declarations; without braces they end on their line."""
    out = []
    for m in re.compile(pattern, re.M).finditer(source.mask) if pattern else ():
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        after = m.end()
        if "params" in m.re.groupindex and m["params"]:
            after = m.start("params") + len(source.arguments(m.start("params")))
        block = source.block(after, stop)
        out.append((m[group], start, block[1] if block else after, m))
    return out


def _owner(at: int, spans: list[tuple[str, int, int, re.Match]]) -> str | None:
    around = [s for s in spans if s[1] < at < s[2]]
    return max(around, key=lambda s: s[1])[0] if around else None


def parse_profile(language: str, path: str, text: str) -> dict:
    p = PROFILES[language]
    s = Source(text, p.style)
    out = symbols(language, module_docstring=s.comment())
    if p.imports:
        if language == "go":
            head = re.compile(r"^import[ \t]*(?:\((?P<b>[^)]*)\)|(?P<s>[^\n]+))", re.M)
            out["imports"] = [x.strip() for m in head.finditer(text) for x in (m["b"] or m["s"]).splitlines() if '"' in x]
        else:
            at = [(m.start("name"), m.end("name")) for m in re.compile(p.imports, re.M).finditer(text)]
            out["imports"] = [text[a:b].strip() for a, b in at if s.mask[a] == text[a]]
    classes = _spanned(s, p.classes, "name", p.stop)
    owners = classes + (_spanned(s, p.owners, "of") if p.owners else [])
    known: dict[str, dict] = {}
    for name, start, end, _ in classes:
        known[name] = klass(name, s.line(start), s.line(end))
        out["classes"].append(known[name])
        out["exports"].append(name)
    seen: list[tuple[int, int]] = []
    for name, start, end, m in _spanned(s, p.functions, "name", p.stop):
        name = name or m.groupdict().get("init")
        words = set(re.findall(r"\w+", s.mask[start : m.start("name" if m["name"] else "params")]))
        if name in p.not_functions or words & ({"return", "else", "new", "throw", "delete", "case"} & (p.not_functions | {"return", "delete", "case"})) or (language in ("c", "cpp") and not s.block(end if s.mask[end : end + 1] != "}" else m.end(), ";)") and s.mask[end : end + 1] != "}"):
            continue
        if any(a < start < b for a, b in seen):
            continue
        seen.append((start, end))
        of = re.compile(p.owners, re.M).match(s.mask, s.mask.rfind("\n", 0, start) + 1) if p.owners and language == "go" else None
        parent = of["of"] if of else _owner(start, owners)
        if "::" in name:
            parent, _, name = name.rpartition("::")
        args = s.arguments(m.start("params")) if m["params"] else ""
        params = re.sub(r"\s+", " ", args) or "()"
        result = re.compile(p.result, re.M).match(s.mask, m.start("params") + len(args)) if p.result else None
        returns = text[result.start(1) : result.end(1)] if result else m.groupdict().get("returns")
        f = function(name, p.lead + name + params + (p.gives + re.sub(r"\s+", " ", returns) if returns else ""), s.line(start), s.line(end), parent=parent, method=True if p.all_methods or of else None)
        if parent in known:
            known[parent]["methods"].append(f)
        else:
            out["functions"].append(f)
            out["exports"].append(name)
    return out


SCRIPT_CALLS = Calls({
    _HTTP("fetch"): r"\bfetch\s*\(", _HTTP("axios"): r"\baxios\.(?:delete|get|patch|post|put|request)\b", _HTTP("node http"): r"\bhttp\.(?:get|post|request)\b", _HTTP("node https"): r"\bhttps\.(?:get|post|request)\b",
    _DB("PostgreSQL"): r"\bpg\.(?:connect|query)\b", _DB("Mongoose"): r"\bmongoose\.(?:connect|model)\b", _DB("Prisma"): r"\bprisma\.\w+", "API (Supabase)": r"\bsupabase\.\w+", "API (OpenAI SDK)": r"\bopenai\.\w+",
})
_NOT_METHODS = frozenset("catch for function if return switch while with".split())


def parse_script(language: str, path: str, text: str) -> dict:
    """JavaScript and TypeScript: imports, requires, classes with methods, function declarations, calls."""
    s = Source(text, "script")
    out = symbols(language, module_docstring=s.comment())
    found = [(m.start(), m[0].strip().rstrip(";")) for m in re.finditer(r"^[ \t]*import\b[^;\n(]*(?:\{[^}]*\}[^;\n]*)?[\"'][^\"'\n]+[\"']", text, re.M)]
    found += [(m.start(), m[0]) for m in re.finditer(r"\brequire\s*\(\s*[\"'][^\"'\n]+[\"']\s*\)", text)]
    out["imports"] = [x for at, x in sorted(found) if s.mask[at : at + 1] == text[at : at + 1]]
    classes = _spanned(s, r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?class[ \t]+(?P<name>\w+)(?:[ \t]+extends[ \t]+(?P<base>[\w.]+))?", "name")
    known: dict[str, dict] = {}
    for name, start, end, m in classes:
        c = klass(name, s.line(start), s.line(end), bases=[m["base"]] if m["base"] else [])
        c["methods"] = known[name]["methods"] if name in known else c["methods"]
        known[name] = c
        out["classes"].append(c)
        out["exports"].append(name)
        block = s.block(m.end())
        depth = at = 0
        inner = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|async|get|set|override|readonly)[ \t]+)*[#*]?(?P<name>[A-Za-z_$][\w$]*)[ \t]*(?P<params>\()", re.M)
        for f in inner.finditer(s.mask, block[0] + 1, block[1]) if block else ():
            depth += s.mask.count("{", at or block[0] + 1, f.start()) - s.mask.count("}", at or block[0] + 1, f.start())
            at = f.start()
            args = s.arguments(f.start("params"))
            body = s.block(f.start("params") + len(args))
            if depth == 0 and f["name"] not in _NOT_METHODS and body:
                result = re.match(r"\s*:\s*([^{]+?)\s*\{", s.mask[f.start("params") + len(args) :])
                c["methods"].append(function(f["name"], f"function {f['name']}{args}" + (f": {result[1]}" if result else ""), s.line(f.start("name")), s.line(body[1]), parent=name))
    for name, start, end, m in _spanned(s, r"^[ \t]*(?P<out>export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<name>[\w$]+)[ \t]*(?:<[^>\n]*>)?(?P<params>\()", "name"):
        args = s.arguments(m.start("params"))
        result = re.match(r"\s*:\s*([^{;]+?)\s*\{", s.mask[m.start("params") + len(args) :])
        out["functions"].append(function(name, f"function {name}{args}" + (f": {result[1]}" if result else ""), s.line(start), s.line(end)))
        if m["out"]:
            out["exports"].append(name)
    called = []
    for m in re.finditer(r"[\w$.]+[ \t]*\(", s.mask):
        whole = text[m.start() : m.end() - 1] + s.arguments(m.end() - 1)
        if not m[0].startswith("require"):
            called.append((SCRIPT_CALLS.first(m[0]), s.line(m.start()), whole))
    out["external_calls"] = SCRIPT_CALLS.rows(called)
    return out


_MODIFIERS = "abstract default final native non-sealed private protected public sealed static strictfp synchronized".replace(" ", "|")
_JAVA_CLASS = re.compile(rf"^[ \t]*(?:(?:{_MODIFIERS})[ \t]+)*(?:class|interface|enum)[ \t]+(?P<name>[A-Za-z_]\w*)", re.M)
_JAVA_METHOD = re.compile(rf"^[ \t]*(?:(?:{_MODIFIERS})[ \t]+)*(?:[A-Za-z_][\w<>\[\],.? ]*[ \t]+)?(?P<name>[A-Za-z_]\w*)[ \t]*\((?P<params>[^{{}};\n]*)\)[ \t]*(?:throws[ \t]+[^{{\n]+)?\{{?[ \t]*$", re.M)


def parse_java(path: str, text: str) -> dict:
    """Line by line: imports, types with their spans, methods whose line ends with the parentheses or the brace."""
    s = Source(text, "c")
    start = text.lstrip()
    doc = start[2 : start.find("*/")].strip() if start.startswith("/*") and "*/" in start else None
    out = symbols("java", module_docstring=doc, imports=[m[0].strip() for m in re.finditer(r"^[ \t]*import[ \t]+[\w.*]+[ \t]*;[ \t]*$", text, re.M)])
    spans, known = [], {}
    for m in _JAVA_CLASS.finditer(s.mask):
        block = s.block(m.end())
        end = block[1] if block else len(text)
        spans.append((m["name"], m.start(), end, m))
        known[m["name"]] = klass(m["name"], s.line(m.start("name")), min(s.line(end), len(text.splitlines()) or 1))
        out["classes"].append(known[m["name"]])
        out["exports"].append(m["name"])
    for m in _JAVA_METHOD.finditer(s.mask):
        if m["name"] in PROFILES["go"].not_functions or re.match(r"\s*(?:return|throw|new|else)\b", m[0]):
            continue
        parent, n = _owner(m.start("name"), spans), s.line(m.start("name"))
        f = function(m["name"], f"{m['name']}({text[m.start('params') : m.end('params')].strip()})", n, n, parent=parent)
        if parent:
            known[parent]["methods"].append(f)
        else:
            out["functions"].append(f)
            out["exports"].append(m["name"])
    return out


def parse_hcl(language: str, path: str, text: str) -> dict:
    """Every block, nested ones too: a class and a function of its type and first label."""
    s = Source(text, "hash")
    out = symbols(language)
    for m in re.finditer(r"^[ \t]*(?P<type>[A-Za-z_][\w-]*)(?P<labels>(?:[ \t]+(?:\"[^\"\n]*\"|[\w-]+))*)[ \t]*\{", text, re.M):
        if s.mask[m.end() - 1] != "{":
            continue
        labels = re.findall(r"\"([^\"]*)\"|([\w-]+)", m["labels"])
        label = next((a or b for a, b in labels), None)
        name = f"{m['type']}.{label}" if label else m["type"]
        start, end = s.line(m.start("type")), s.line(s.close.get(m.end() - 1, len(text)))
        out["classes"].append(klass(name, start, end, f"{m['type']} block"))
        out["functions"].append(function(m["type"], m[0].rstrip("{").strip()[:200], start, end))
        out["exports"].append(name)
        if label and m["type"] in ("module", "provider"):
            out["imports"].append(f'{m["type"]} "{label}"')
    if out["exports"]:
        out["module_docstring"] = f"Infrastructure as Code ({language}): " + ", ".join(out["exports"][:10])
    return out


# ---------------------------------------------------------------- YAML

_SHOWN = frozenset("apiVersion kind metadata name namespace labels annotations spec replicas containers image port selector".split())
_WORKLOADS = "CronJob DaemonSet Deployment Job Pod ReplicaSet StatefulSet"
_OTHERS = "ClusterRole ClusterRoleBinding ConfigMap HorizontalPodAutoscaler Ingress Namespace NetworkPolicy PersistentVolume PersistentVolumeClaim Role RoleBinding Secret Service ServiceAccount"
KINDS = frozenset(f"{_WORKLOADS} {_OTHERS}".split())


def yaml_pairs(text: str) -> dict[str, str]:
    """Every key at any depth with the text of its value, the last of equal keys counts; long values are left out."""
    import yaml

    pairs: dict[str, str] = {}

    def visit(node) -> None:
        if isinstance(node, yaml.MappingNode):
            for k, v in node.value:
                value = v.value if isinstance(v, yaml.ScalarNode) else text[v.start_mark.index : v.end_mark.index]
                if isinstance(k, yaml.ScalarNode) and k.value and value.strip() and len(value.strip()) < 200:
                    pairs[k.value] = value.strip()
                visit(v)
        elif isinstance(node, yaml.SequenceNode):
            for v in node.value:
                visit(v)

    for document in yaml.compose_all(text, Loader=yaml.SafeLoader):
        visit(document)
    return pairs


def parse_yaml(path: str, text: str) -> dict:
    import yaml

    error = None
    try:
        pairs = yaml_pairs(text)
    except (yaml.YAMLError, RecursionError, ValueError) as e:
        error = type(e).__name__
        pairs = {m[1]: m[2].strip().strip("\"'") for m in re.finditer(r"^[ \t-]*([\w./-]+):[ \t]+(\S[^\n]{0,198})$", text, re.M)}
    out = symbols("yaml", exports=[f"{k}: {v}" for k, v in pairs.items() if k in _SHOWN], error=error)
    if not {"apiVersion", "kind"} <= pairs.keys():
        if pairs:
            out["module_docstring"] = "YAML configuration keys: " + ", ".join(list(pairs)[:30])
        return out
    kind, api = pairs["kind"], pairs["apiVersion"]
    name = pairs.get("name", pairs.get("metadata", "unnamed"))
    images = [m[1].strip().strip("\"'") for m in re.finditer(r"^[ \t-]*image:[ \t]*(\S[^\n]*)$", text, re.M)]
    return out | {
        "language": "kubernetes",
        "module_docstring": f"Kubernetes {kind} manifest (apiVersion: {api})\nResource name: {name}",
        "imports": [f"apiVersion: {api}", f"kind: {kind}", *(f"image: {i}" for i in images if i)],
        "classes": [klass(f"{kind}/{name}", 1, text.count("\n") + 1, f"Kubernetes {kind} resource")],
        "exports": ([f"K8s/{kind}"] if kind in KINDS else []) + out["exports"],
    }


# ---------------------------------------------------------------- line-oriented languages


def parse_dockerfile(path: str, text: str) -> dict:
    out = symbols("dockerfile")
    for n, line in enumerate(text.splitlines(), 1):
        op, _, rest = line.strip().partition(" ")
        if op.upper() in INSTRUCTIONS:
            out["functions"].append(function(op.upper(), line.strip(), n, n))
            if op.upper() == "FROM":
                out["imports"].append(rest.strip())
    out["exports"] = list(dict.fromkeys(f["name"] for f in out["functions"]))
    if out["functions"]:
        out["module_docstring"] = "Dockerfile instructions: " + ", ".join(f["name"] for f in out["functions"][:20])
    return out


PLSQL_OVERVIEW = "Oracle PL/SQL script with packages, procedures, or blocks."


def parse_sql(path: str, text: str) -> dict:
    """Statements by label, and objects where the text is PL/SQL."""
    score = sum(bool(re.search(word(p), text)) for p in PLSQL_SIGNS)
    plsql = score >= 2 or bool(re.search(word(r"EXECUTE\s+IMMEDIATE"), text)) or path.lower().endswith((".plsql", ".pls", ".pkb", ".pks"))
    out = symbols("plsql" if plsql else "sql", module_docstring=PLSQL_OVERVIEW if plsql else None)
    line = lambda at: text.count("\n", 0, at) + 1
    for label, p in STATEMENTS:
        for m in re.finditer(word(p), text):
            out["functions"].append(function(label, m[0][:200], line(m.start()), line(m.start())))
            out["exports"].append(label)
    for kind, p in [(x, rf"CREATE\s+{_REPLACE}{x}") for x in OBJECTS] + [("PL/SQL_BLOCK", "DECLARE")] if plsql else []:
        for m in re.finditer(word(p), text):
            snippet = text[m.start() : m.start() + 120].split("\n")[0].strip()
            found = re.search(rf"(?i)(?:{'|'.join(OBJECTS)})\s+(\w+)", snippet)
            out["classes"].append(klass(f"{kind}:{found[1] if found else kind}", line(m.start()), line(m.start()), snippet))
            out["exports"].append(f"{kind} {found[1] if found else kind}")
    return out


_TOOLS = {label: rf"\b{tool}\b" for tool, label in TOOLS.items()}


def parse_shell(path: str, text: str) -> dict:
    rows = list(enumerate(text.splitlines(), 1))
    s = Source(text, "hash")
    out = symbols("bash", imports=[x.strip() for _, x in rows if x.strip().startswith(("source ", ". "))])
    for m in re.finditer(r"^[ \t]*(?:function[ \t]+(?P<a>[\w-]+)(?:[ \t]*\(\))?|(?P<b>[\w-]+)[ \t]*\(\))\s*\{", text, re.M):
        name = m["a"] or m["b"]
        out["functions"].append(function(name, m[0].split("{")[0].strip()[:120], s.line(m.start(m.lastgroup)), s.line(s.close.get(m.end() - 1, len(text)))))
        out["exports"].append(name)
    calls = Calls(_TOOLS)
    out["external_calls"] = calls.rows((label, n, x) for n, x in rows for label, p in calls.labels if p.search(x))
    if out["external_calls"]:
        out["module_docstring"] = "Shell script using: " + ", ".join(sorted({c["pattern"] for c in out["external_calls"]}))
    return out


def parse_env(path: str, text: str) -> dict:
    rows = [x.strip() for x in text.splitlines()]
    return symbols("env", exports=[x.split("=", 1)[0] for x in rows if x and not x.startswith("#")])


def parse_ruby(path: str, text: str) -> dict:
    """Requires, classes, modules and methods; ``end`` is paired by indentation."""
    rows = text.splitlines()
    out = symbols("ruby", imports=[x.strip() for x in rows if re.match(r"\s*require(?:_relative)?\s", x)])

    def end(i: int, indent: str) -> int:
        return next((k + 1 for k in range(i + 1, len(rows)) if re.match(rf"{indent}end\b", rows[k])), i + 1)

    stack: list[tuple[dict, int]] = []
    for i, x in enumerate(rows):
        if m := re.match(r"(\s*)(?:class|module)\s+([A-Z]\w*)(?:\s*<\s*([\w:]+))?", x):
            c = klass(m[2], i + 1, end(i, m[1]), bases=[m[3]] if m[3] else [])
            out["classes"].append(c)
            out["exports"].append(m[2])
            stack.append((c, c["line_end"]))
        elif m := re.match(r"(\s*)def\s+((?:self\.)?\w+[?!=]?)\s*(\([^)]*\))?", x):
            stack = [s for s in stack if s[1] > i]
            parent = stack[-1][0] if stack else None
            f = function(m[2], f"{m[2]}{m[3] or '()'}", i + 1, end(i, m[1]), parent=parent and parent["name"], method=True)
            (parent["methods"] if parent else out["functions"]).append(f)
            if not parent:
                out["exports"].append(m[2])
    return out


PARSERS: dict[str, Callable[[str, str], dict]] = {"python": parse_python, "java": parse_java, "yaml": parse_yaml, "kubernetes": parse_yaml, "dockerfile": parse_dockerfile, "sql": parse_sql, "plsql": parse_sql, "bash": parse_shell, "shell": parse_shell, "ruby": parse_ruby}
PARSERS |= {x: parse_env for x in ("env", "properties", "ini")}
PARSERS |= {x: lambda path, text, x=x: parse_script(x, path, text) for x in ("javascript", "typescript")}
PARSERS |= {x: lambda path, text, x=x: parse_hcl(x, path, text) for x in ("hcl", "terraform")}
PARSERS |= {x: lambda path, text, x=x: parse_profile(x, path, text) for x in PROFILES}


def parse_file(path: str, language: str, text: str | None) -> dict | None:
    """Symbols of one file; None for an unknown language."""
    parser = PARSERS.get(language)
    if parser is None:
        return None
    try:
        return parser(path, text or "")
    except Exception as e:  # noqa: BLE001 - a file that breaks a parser must not end the job
        return symbols(language, error=f"{type(e).__name__}: {e}"[:200])


def parsed(files: DataFrame) -> DataFrame:
    """(path, size, mtime_ns, content_sha256, symbols, external_urls, database_endpoints) of files in a known language.

    ``files`` has path, size, mtime_ns and content. Null contents are empty. Contexts are
    redacted, so that no secret in them is stored.
    """

    kind = to_arrow_type(SYMBOLS)

    def read(paths: pa.Array, languages: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([parse_file(*row) for row in zip(paths.to_pylist(), languages.to_pylist(), texts.to_pylist())], kind)

    known = files.where("path is not null").withColumn("__lang", detect_language(F.col("path"))).where(F.col("__lang").isin(*PARSERS))
    found = known.withColumn("__s", F.arrow_udf(read, SYMBOLS)("path", "__lang", "content"))
    text = F.coalesce("content", F.lit(""))
    searched = F.when(F.col("__s.language").isin(*NOT_SEARCHED), F.lit("")).otherwise(text)
    calls = F.transform("__s.external_calls", lambda c: c.withField("context", redact_secrets(c["context"])))
    columns = [calls.alias(f) if f == "external_calls" else F.col(f"__s.{f}").alias(f) for f in SYMBOLS.names]
    return found.select("path", "size", "mtime_ns", F.sha2(F.encode(text, "utf-8"), 256).alias("content_sha256"), *columns, text_urls(searched).alias("external_urls"), text_endpoints(searched).alias("database_endpoints"))


#: Templates of source files by suffix: @K a number, @C a type's name, @F a function's.
SAMPLES = {
    ".py": '"""Module @K."""\nimport os\nfrom pkg import @F\n\n@decorated\nclass @C(Base):\n    """A @C."""\n    @property\n    def @F(self, a: int = 1) -> int:\n        return requests.get("https://host@K.example/x")\n\n\ndef run_@F(x):\n    """Runs."""\n    return helper(@C(x))\n',
    ".js": '/** Client @K */\nimport a from "./m@K";\nconst b = require("fs");\nexport class @C extends Base {\n  constructor(u) {\n    this.u = u;\n  }\n  async @F(x) {\n    return fetch("https://host@K.example/" + x);\n  }\n}\nfunction helper@K(y) {\n  return y;\n}\n',
    ".java": 'package p;\nimport java.util.List;\npublic class @C {\n  // class Not {\n  public int @F(int a) {\n    if (a > @K) {\n      return 1;\n    }\n    return 0;\n  }\n}\n',
    ".yaml": 'apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: @F-@K\nspec:\n  containers:\n    - image: "repo/@F:@K"\n',
    ".tf": 'resource "vm" "@F" {\n  disk {\n    size = @K\n  }\n}\nmodule "net@K" {\n  source = "./{x}"\n}\n',
    ".go": 'package main\n\nimport (\n\t"fmt"\n)\n\ntype @C struct {\n\tn int\n}\n\nfunc (c *@C) Get@K(a int) int {\n\treturn c.n\n}\n\nfunc @F() {\n\tfmt.Println("}")\n}\n',
    ".rs": "use std::io;\n\npub struct @C {\n    n: u32,\n}\n\nimpl @C {\n    pub fn @F(&self) -> u32 {\n        self.n + @K\n    }\n}\n",
    ".cs": "using System;\nnamespace N {\n  public class @C {\n    public @C(int n) {\n    }\n    public int @F(string s) {\n      return @K;\n    }\n  }\n}\n",
    ".sql": "CREATE TABLE t@K (id INT);\nSELECT * FROM t@K;\n",
    ".dockerfile": "FROM base:@K\nRUN make @F\nCOPY . /app\n",
    ".sh": '#!/bin/bash\nsource ./env\n@F() {\n  curl "https://host@K.example"\n}\n',
    ".properties": "# db\nDB_HOST=db@K.internal\nname.@F=1\n",
    ".rb": "require 'json'\nclass @C\n  def @F(a)\n    a\n  end\nend\ndef top@K\nend\n",
    ".c": "#include <stdio.h>\nstruct @C {\n  int n;\n};\nint @F(int a) {\n  return a + @K;\n}\n",
    ".cpp": "#include <vector>\nclass @C {\n public:\n  int @F() {\n    return @K;\n  }\n};\nvoid run@K(int a) {\n}\n",
    ".php": "<?php\nuse A\\B;\nclass @C {\n  public function @F($a) {\n    return @K;\n  }\n}\nfunction run@K() {\n}\n",
    ".kt": "import a.b\nclass @C {\n  fun @F(a: Int): Int {\n    return @K\n  }\n}\n",
    ".scala": "import a.b\nobject @C {\n  def @F(a: Int): Int = {\n    @K\n  }\n}\n",
    ".swift": "import Foundation\nstruct @C {\n  func @F(a: Int) -> [Int] {\n    return [@K]\n  }\n}\n",
}
