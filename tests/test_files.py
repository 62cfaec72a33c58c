"""Trees on disk: listing, parsing, linking, incremental runs, rendering and bundling."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sluice import api
from sluice.operators import links, parsers, project, render, stack
from sluice.plans import catalogue
from sluice.schemas import PARSED
from sluice.sources import repository as R
from sluice.streaming.snapshot import Store

from .compare import DATA

TREE = {
    "pkg/__init__.py": "",
    "pkg/core.py": '"""Core."""\nimport os\nfrom .util import f\nfrom pkg.sub import thing\n\nclass A(B):\n    def m(self):\n        return f(requests.get("https://api.example/x"))\n\ndef main(a, b=1):\n    def inner():\n        pass\n    return helper(a)\n',
    "pkg/util.py": "def f(x):\n    return x\n",
    "pkg/sub/__init__.py": "thing = 1\n",
    "pkg/broken.py": "def half(:\n",
    "web/a.js": 'import b from "./b";\nconst u = "http://cdn.example/lib.js";\n',
    "web/b.js": "export function b() { return fetch('/x'); }\n",
    ".env": "DB_HOST=db.internal\nDB_PASSWORD=hunter22\n",
    "deploy/Dockerfile": "FROM base\nRUN x\n",
    "node_modules/x.js": "no",
    "ignored/x.py": "no",
    "eggs/x.py": "no",
    "out/target/vendor/env/kept.py": "y = 1\n",
    "kept.log.py": "x = 1\n",
    "data.png": "no",
    "requirements.txt": "alpha>=1\nbeta[x]\n# c\n",
    "go.mod": "module m\nrequire (\n\tgithub.com/a/b v1.0\n)\nrequire github.com/c/d v2\n",
    ".gitignore": "ignored/\n*.log\n!kept.log.py\n",
}


@pytest.fixture
def tree(tmp_path):
    for path, text in TREE.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "nul.py").write_bytes(b"a\0b")
    (tmp_path / "large.py").write_bytes(b"#" * (R.MAX_BYTES + 1))
    return tmp_path


def test_source(spark, tree):
    rows = {r["path"]: r for r in R.read_repository(spark, str(tree), partitionBytes="5000").collect()}
    assert set(rows) == {".env", "deploy/Dockerfile", "kept.log.py", "out/target/vendor/env/kept.py", "pkg/__init__.py", "pkg/broken.py", "pkg/core.py", "pkg/sub/__init__.py", "pkg/util.py", "web/a.js", "web/b.js"}
    assert rows["pkg/util.py"]["content"] == TREE["pkg/util.py"] and rows["pkg/util.py"]["size"] == len(TREE["pkg/util.py"])
    only = R.read_repository(spark, str(tree), "env,k8s").collect()
    assert [r["path"] for r in only] == [".env"]


@pytest.mark.parametrize(
    "rules, path, folder, out",
    [("*.log", "a/b.log", False, True), ("/x", "a/x", False, False), ("/x", "x", False, True), ("a/**/z", "a/b/c/z", False, True), ("d/", "d", False, False), ("d/", "q/d", True, True), ("*.x\n!k.x", "k.x", False, False), ("[ab].c", "b.c", False, True), ("# x", "# x", False, False), ("\\#x", "#x", False, True), ("a?c", "abc", False, True), ("a*c", "a/c", False, False)],
)
def test_ignore_rules(rules, path, folder, out):
    assert R.Ignored(rules.split("\n"))(path, folder) is out


def test_python_symbols():
    found = parsers.parse_python("x.py", TREE["pkg/core.py"])
    assert found["module_docstring"] == "Core." and found["imports"] == ["import os", "from .util import f", "from pkg.sub import thing"]
    assert [f["name"] for f in found["functions"]] == ["main"] and found["functions"][0]["internal_calls"] == ["helper"]
    assert found["classes"][0]["methods"][0]["name"] == "m" and found["classes"][0]["bases"] == ["B"]
    assert found["external_calls"] == [{"pattern": "HTTP (requests)", "line": 8, "context": 'requests.get("https://api.example/x")'}]
    assert found["exports"] == ["main", "A"]
    broken = parsers.parse_python("x.py", "import os\nclass K:\n  pass\ndef half(:\n")
    assert broken["error"] == "SyntaxError" and broken["imports"] == ["import os"] and broken["exports"] == ["K"]


@pytest.mark.parametrize("suffix", parsers.SAMPLES)
def test_samples_have_what_they_declare(suffix):
    """Brute force: each template says which names it declares."""
    text = parsers.SAMPLES[suffix].replace("@K", "7").replace("@C", "Widget").replace("@F", "make")
    lang = R.language_of("x" + suffix)
    found = parsers.parse_file("x" + suffix, lang, text)
    assert found["error"] is None
    names = {c["name"] for c in found["classes"]} | {f["name"] for f in found["functions"]} | {m["name"] for c in found["classes"] for m in c["methods"]}
    expected = {
        ".py": {"Widget", "make", "run_make"}, ".js": {"Widget", "constructor", "make", "helper7"}, ".java": {"Widget", "make"}, ".yaml": {"Deployment/make-7"}, ".tf": {"resource.vm", "disk", "module.net7", "resource", "module"}, ".go": {"Widget", "Get7", "make"},
        ".rs": {"Widget", "make"}, ".cs": {"Widget", "make"}, ".sql": {"TABLE", "SELECT"}, ".dockerfile": {"FROM", "RUN", "COPY"}, ".sh": {"make"}, ".properties": set(), ".rb": {"Widget", "make", "top7"}, ".c": {"Widget", "make"}, ".cpp": {"Widget", "make", "run7"}, ".php": {"Widget", "make", "run7"}, ".kt": {"Widget", "make"}, ".scala": {"Widget", "make"}, ".swift": {"Widget", "make"},
    }
    assert names == expected[suffix]


@pytest.mark.parametrize("lang, text, names", [
    ("c", "#include <a.h>\nstruct S { int a; };\nstatic int f(int x) {\n  if (x) { return g(x); }\n}\nint g(int);\n", {"S", "f"}),
    ("cpp", "class K {\n public:\n  int m() { return 1; }\n};\nvoid K::n(int a) {\n}\n", {"K", "m", "n"}),
    ("php", "<?php\nuse A\\B;\nclass K {\n  public function m($a) { return 1; }\n}\nfunction f() {}\n", {"K", "m", "f"}),
    ("kotlin", "import a.b\nclass K {\n  fun m(a: Int): Int = 1\n}\nfun f() {\n}\n", {"K", "m", "f"}),
    ("scala", "import a.b\nobject K {\n  def m(a: Int): Int = {\n    1\n  }\n}\n", {"K", "m"}),
    ("swift", "import F\nstruct K {\n  init(a: Int) {\n  }\n  func m() {\n  }\n}\n", {"K", "init", "m"}),
])
def test_profiles(lang, text, names):
    found = parsers.parse_file("x", lang, text)
    assert found["error"] is None and len(found["imports"]) == (lang != "cpp")
    assert {c["name"] for c in found["classes"]} | {f["name"] for f in found["functions"]} | {m["name"] for c in found["classes"] for m in c["methods"]} == names


def test_yaml():
    many = parsers.parse_yaml("x", "a: 1\nb:\n  c: [1, 2]\n")
    assert many["language"] == "yaml" and many["module_docstring"] == "YAML configuration keys: a, b, c"
    assert parsers.parse_yaml("x", "a: [1\nb: 2\n")["error"] and parsers.parse_yaml("x", "")["exports"] == []


def test_stack(spark):
    pom = "<project><parent><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter-parent</artifactId></parent><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency></dependencies></project>"
    rows = [("pom.xml", pom), ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1"\n[dev-dependencies]\nno = "1"\n'), ("package.json", '{"dependencies": {"b": "1"}, "devDependencies": {"a": "2", "b": "3"}}'), ("sub/build.gradle", "implementation 'g:h:1'\n"), ("sub/go.mod", "require a v1"), ("requirements.txt", TREE["requirements.txt"]), ("go.mod", TREE["go.mod"])]
    found = {(r["ecosystem"], r["package"]) for r in stack.packages(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert found == {("java_packages", "g:a"), ("java_packages", "org.springframework.boot:spring-boot-starter-parent (parent)"), ("java_packages", "g:h:1"), ("rust_crates", "serde"), ("node_packages", "a"), ("node_packages", "b"), ("python_packages", "alpha"), ("python_packages", "beta"), ("go_modules", "github.com/a/b"), ("go_modules", "github.com/c/d")}


def test_init_again_and_bundle(spark, tree):
    first = api.init(spark, str(tree))
    assert first["discovered"] == 11 and first["reused"] == 0 and first["parsed"] == 11
    out = tree / api.FOLDER
    names = sorted(os.listdir(out / "modules"))
    assert "pkg_core_py.md" in names and "_env.md" in names and len(names) == 11
    core = (out / "modules/pkg_core_py.md").read_text()
    assert "internal_dependencies" in core and "pkg/util.py" in core and "https://api.example/x" in core
    index = (out / "project_index.md").read_text()
    assert "db.internal" in index and "http://cdn.example/lib.js" in index and "`web/a.js` → `web/b.js`" in index and "- alpha" in index
    assert not any("hunter22" in p.read_text(errors="replace") for p in out.rglob("*.md"))
    again = api.init(spark, str(tree))
    assert again["reused"] == 11 and again["deleted"] == 0 and sorted(os.listdir(out / "modules")) == names
    (tree / "pkg/util.py").write_text("def g(x):\n    return x + 1\n")
    (tree / "web/a.js").unlink()
    third = api.init(spark, str(tree))
    assert (third["reused"], third["deleted"], third["parsed"]) == (9, 1, 10)
    assert "def g" in (out / "modules/pkg_util_py.md").read_text() and not (out / "modules/web_a_js.md").exists()
    found = api.bundle(spark, str(tree))
    text = (out / "bundle.md").read_text()
    assert found["parts"] == 11 and found["characters"] == len(text) and found["words"] == len(text.split()) and text.index("Project Index") < text.index("File: `")
    assert api.main(["bundle", str(tree / "pkg")]) == 1


def test_empty_tree(spark, tmp_path):
    assert api.init(spark, str(tmp_path))["discovered"] == 0
    assert api.main(["init", str(tmp_path)]) == 0


def test_broken_snapshot_is_none(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", PARSED)
    assert store.load().isEmpty()
    (tmp_path / "s").mkdir(exist_ok=True)
    (tmp_path / "s/CURRENT").write_text("{half")
    assert store.load().isEmpty()
    (tmp_path / "s/CURRENT").write_text(json.dumps({"version": 1, "filter": {}, "data": "gone"}))
    assert store.load().isEmpty()


def test_store_and_stream(spark, tmp_path):
    schema = "path string, size long, mtime_ns long, seen string"
    from pyspark.sql.types import _parse_datatype_string

    store = Store(spark, f"file://{tmp_path}/s", _parse_datatype_string(schema))
    parse = lambda rows: rows.withColumn("seen", F.lit("parsed"))
    (tmp_path / "in").mkdir()
    for k, rows in enumerate([[("a", 1, 1), ("b", 1, 1)], [("b", 2, 2), ("c", 1, 1)]]):
        spark.createDataFrame(rows, "path string, size long, mtime_ns long").coalesce(1).write.json(str(tmp_path / f"w{k}"))
        for f in os.listdir(tmp_path / f"w{k}"):
            if f.endswith(".json"):
                os.rename(tmp_path / f"w{k}" / f, tmp_path / "in" / f"{k}.json")
        stream = spark.readStream.schema("path string, size long, mtime_ns long").json(str(tmp_path / "in"))
        store.follow(stream, parse, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["path"], r["size"]) for r in store.load().collect()) == [("a", 1), ("b", 2), ("c", 1)]
    store.remove(spark.createDataFrame([("a",)], "path string"))
    assert sorted(r["path"] for r in store.known_paths().collect()) == ["b", "c"]


def test_collisions_and_links(spark):
    files = spark.createDataFrame([("a/b_c.py",), ("a_b/c.py",), ("x/m.py",), ("x/main.py",), ("lib/m.js",), ("lib/main.js",), ("com/p/K.java",), ("com/p/L.java",)], "path string")
    names = [r["kb_name"] for r in project.named_documents(files).collect()]
    assert len(set(names)) == len(names)
    imports = spark.createDataFrame([("x/main.py", "python", "from .m import q"), ("x/main.py", "python", "from . import x"), ("lib/main.js", "javascript", 'import a from "../lib/m"'), ("com/p/K.java", "java", "import com.p.*;"), ("x/main.py", "python", "import os")], "path string, language string, stmt string")
    found = {tuple(r) for r in links.edges_resolved(imports, files).collect()}
    assert found == {("x/main.py", "x/m.py"), ("lib/main.js", "lib/m.js"), ("com/p/K.java", "com/p/L.java")}


def test_python_and_script_imports(spark):
    paths = ["p/mod.py", "p/__init__.py", "p/q/__init__.py", "p/q/r.py", "lib/p/mod.py", "x/util.ts", "y/util.ts", "util.py", "a/setup.cfg", "a/web/lib.js", "other/mod.js"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    cases = [
        ("a/m.py", "python", "import p.mod.fn", {"p/mod.py"}),
        ("b/m.py", "python", "import p.mod", {"p/mod.py"}),
        ("p/m.py", "python", "from . import mod, q as z", {"p/__init__.py", "p/mod.py"}),
        ("p/n.py", "python", "from . import (mod,\n  nothing)", {"p/__init__.py", "p/mod.py"}),
        ("p/q/s.py", "python", "from .. import mod", {"p/__init__.py", "p/mod.py"}),
        ("p/q/t.py", "python", "from .r import z", {"p/q/r.py"}),
        ("p/q/u.py", "python", "from ..mod import z", {"p/mod.py"}),
        ("c/m.py", "python", "import util", {"util.py"}),
        ("d/m.py", "python", "import setup.x", {"a/setup.cfg"}),
        ("e/m.py", "python", "import os", set()),
        ("q/m.py", "python", "from .mod import z", set()),
        ("web/a.js", "javascript", 'import b from "lib"', set()),
        ("a/web/a.js", "javascript", 'const b = require("./lib")', {"a/web/lib.js"}),
        ("web/c.js", "javascript", 'import b from "./lib"', {"a/web/lib.js"}),
        ("p/__init__.py", "python", "import p", set()),
    ]
    imports = spark.createDataFrame([c[:3] for c in cases], "path string, language string, stmt string")
    found = {tuple(r) for r in links.edges_resolved(imports, files).collect()}
    assert found == {(c[0], t) for c in cases for t in c[3]}


def test_nested_and_one_line_declarations():
    found = parsers.parse_python("x", "def f():\n    class I:\n        def m(self):\n            class J: pass\n    def g(): pass\n")
    assert [c["name"] for c in found["classes"]] == ["I", "J"] and [m["name"] for m in found["classes"][0]["methods"]] == ["m"] and [f["name"] for f in found["functions"]] == ["f"]
    signatures = lambda lang, text: [(f["signature"], f["parent_class"]) for x in [parsers.parse_file("x", lang, text)] for f in x["functions"] + [m for c in x["classes"] for m in c["methods"]]]
    assert signatures("rust", "struct A;\nimpl A { fn f(&self) -> u32 { 1 } fn g() {} }\npub fn h<T>(a: T) -> Vec<T> where T: X {\n}\n") == [("fn h(a: T) -> Vec<T>", None), ("fn f(&self) -> u32", "A"), ("fn g()", "A")]
    assert signatures("go", "package m\nfunc (a *A) M(x int) (int, error) {\n}\nfunc N() {\n}\n") == [("func M(x int) (int, error)", "A"), ("func N()", None)]
    assert signatures("kotlin", "class K { fun m(a: Int): Int = 1\n fun n() { } }\n") == [("m(a: Int): Int", "K"), ("n()", "K")]
    assert signatures("csharp", "class K { public static async Task<int> G() { } public K(int n) {} }") == [("G(): Task<int>", "K"), ("K(int n)", "K")]
    assert parsers.parse_sql("x.sql", "CREATE OR REPLACE PROCEDURE p AS\nBEGIN\nEND;")["module_docstring"]


def test_render_empty(spark):
    row = spark.createDataFrame([("a.py", 0, 0, "")], "path string, size long, mtime_ns long, content string")
    text = render.modules(parsers.parsed(row)).first()["markdown"]
    assert "*No module-level documentation found.*" in text and "## Imports" not in text


def test_large_trees_are_dealt_out(spark, tmp_path, monkeypatch):
    """A listing by folders and parts of folders finds each file once, with the same rules, and isn't held by the driver."""
    rows = [(f"{d}/m{i}{end}", f"x = {i}") for d in ("a", "a/b", "node_modules", "gone", "c d/é", "e/" * 130 + "f") for i in range(30) for end in (".py", ".txt", ".skip.js")]
    rows += [(f"many/f{i}/x.py", "y") for i in range(60)] + [("top.go", ""), ("nul.py", "a\0"), ("large.py", "z" * 500), (".gitignore", "gone/\n*.skip.*\n!m1.skip.js\n")]
    R.write_tree(spark.createDataFrame(rows, "path string, content string").repartition(3), str(tmp_path))
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.symlink(tmp_path / "nothing.py", tmp_path / "broken.py")
    read = lambda: sorted(tuple(r) for r in R.read_repository(spark, str(tmp_path), maxBytes="400").select("path", "size", "content").collect())
    expected = read()
    assert len(expected) == 4 * 31 + 60 + 1
    reader = lambda: R.RepositoryReader({"path": str(tmp_path), "maxbytes": "400"})
    for folders, entries in ((2000, 4096), (2000, 7), (3, 7), (1, 1000)):
        for name, value in (("LISTED", 20), ("FOLDERS", folders), ("ENTRIES", entries)):
            monkeypatch.setattr(R, name, value)
        dealt = reader().partitions()
        assert all(isinstance(p, R.Places) for p in dealt) and not any("m1.py" in str(p) for p in dealt)
        assert sorted((r[0], r[1], r[3]) for p in dealt for r in reader().read(p)) == expected


def test_names_of_modules_without_a_broadcast_of_all(spark, monkeypatch):
    """Only names that clash are joined; a small file of paths doesn't let Spark broadcast the names of all documents."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(catalogue.QUERIES["rendered_modules"](spark, str(DATA / "sf0.001")))
    paths = ["a/b_c.py", "a_b/c.py", "a_b_c.py", "x/m.py", None, "d/" * 120 + "e.py"]
    rows = spark.createDataFrame([(p, 0, 0, "") for p in paths], "path string, size long, mtime_ns long, content string")
    parsed = parsers.parsed(rows)
    names = {tuple(r) for r in project.named_documents(parsed.where("path is not null")).collect()}
    for limit, kind in ((8 << 20, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(render, "BROADCAST_BYTES", limit)
        documents = render.modules(parsed)
        assert kind in plan(documents)
        found = [tuple(r) for r in documents.select("path", "kb_name").collect()]
        assert len(found) == 5 and set(found) == names


def test_links_of_deep_paths(spark):
    deep = "/".join(f"d{i}" for i in range(14))
    paths = [f"{deep}/a.ts", f"{deep}/b.ts", f"{deep}/m.py", f"{deep}/n.py", f"{deep}/T.java", "x/U.java", "x/v.py"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    dotted = deep.replace("/", ".")
    imports = spark.createDataFrame([(paths[0], "typescript", "import b from './b'"), (paths[2], "python", "from .n import z"), ("x/v.py", "python", f"import {dotted}.m"), ("x/U.java", "java", f"import {dotted}.*;")], "path string, language string, stmt string")
    found = {tuple(r) for r in links.edges_resolved(imports, files).collect()}
    assert {(paths[0], paths[1]), (paths[2], paths[3]), ("x/v.py", paths[2]), ("x/U.java", paths[4])} <= found
