"""Single lines and values: what is found, and that no password survives."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions import languages as L
from sluice.functions import text as T
from sluice.operators import endpoints as E


def applied(spark, values, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", *[c(F.col("v")).alias(f"c{k}") for k, c in enumerate(columns)])
    return [tuple(r)[1:] for r in rows.orderBy("i").collect()]


def test_redaction(spark):
    lines = ["postgres://u:s3cret@h/d", "redis://:s3cret@h:1", 'token = "s3cret"', "PASSWORD: s3cret, x", "nothing here", "", None]
    out = [r[0] for r in applied(spark, lines, T.redact_secrets)]
    assert not any(r and "s3cret" in r for r in out)
    assert out[0] == "postgres://u:***@h/d" and out[1] == "redis://:***@h:1" and out[4:] == ["nothing here", "", None]
    assert out[2] == 'token=***"'


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.from_regex(r"[a-z]{1,9}", fullmatch=True), st.from_regex(r"[A-Za-z0-9!$%^&*_+-]{8,40}", fullmatch=True), st.integers(1024, 65535)), min_size=50, max_size=60))
def test_no_password_survives(spark, rows):
    lines = [f"postgres://{u}x:{p}@db.internal:{port}/d" for u, p, port in rows]
    for (u, p, port), (redacted, parsed) in zip(rows, applied(spark, lines, T.redact_secrets, T.parse_connection)):
        assert f":{p}@" not in redacted
        assert (parsed["host"], parsed["user"], parsed["port"]) == ("db.internal", f"{u}x", str(port))


def test_connections(spark):
    given_ = ["mysql+pymysql://u:p@Host_1:3306/db?schema=s&x=1", "sqlite:///file.db", "mongodb://h:99999/d", "jdbc:oracle://h:1521/x", "plain", "*", "", None]
    out = [r[0] for r in applied(spark, given_, T.parse_connection)]
    assert tuple(out[0]) == ("mysql", "host_1", "3306", "u", "s", "db")
    assert (out[1]["connection_type"], out[1]["database"], out[1]["host"]) == ("sqlite", "file.db", None)
    assert (out[2]["host"], out[2]["port"], out[2]["database"]) == ("h", None, None)
    assert tuple(out[3]) == ("jdbc", "h", "1521", None, None, "x")
    assert (out[4]["connection_type"], out[4]["database"]) == ("generic", "plain")
    assert out[5:] == [None, None, None]


def found(spark, text):
    rows = spark.createDataFrame([(text,)], "v string").select(E.text_endpoints(F.col("v")).alias("e"), E.text_urls(F.col("v")).alias("u")).first()
    return rows["e"], rows["u"]


@pytest.mark.parametrize(
    "line, fields",
    [
        ("export DB_HOST='db.internal'", {"connection_type": "env", "host": "db.internal"}),
        ("DATABASE_URL=postgres://u:p@h:1/d", {"connection_type": "postgres", "host": "h", "user": "u", "port": "1", "database": "d"}),
        ("PGPORT=5432", {"connection_type": "env", "port": "5432"}),
        ("host = db1, port: 5432, user=u", {"connection_type": "config", "host": "db1", "port": "5432", "user": "u"}),
        ('x = {"host": "h1", "port": 99, "database": "d"}', {"connection_type": "config", "host": "h1", "port": "99", "database": "d"}),
        ('create_engine("mysql://u:p@h2/d")', {"connection_type": "mysql", "host": "h2"}),
        ('c = connect("file7")', {"connection_type": "generic", "database": "file7"}),
        ("x = jdbc:postgresql://j:5/d", {"connection_type": "postgres", "host": "j"}),
        ("# mongodb+srv://u:p@m/d in a comment", {"connection_type": "mongodb", "host": "m"}),
    ],
)
def test_one_endpoint(spark, line, fields):
    ends, _ = found(spark, "first\n" + line)
    assert len(ends) == 1 and ends[0]["line"] == 2
    assert {k: ends[0][k] for k in fields} == fields
    assert ":p@" not in ends[0]["context"] + ends[0]["raw_redacted"]


def test_false_positives_and_nulls(spark):
    ends, urls = found(spark, "the host of the party\nSQLALCHEMY_BINDS=x\nprint(a, b)\n\n")
    assert ends == [] and urls == []
    row = spark.createDataFrame([(None,), ("",)], "v string").select(E.text_endpoints(F.col("v")).alias("e"), E.text_urls(F.col("v")).alias("u")).collect()
    assert not row[0]["e"] and row[1]["e"] == [] and row[1]["u"] == []


def test_urls(spark):
    _, urls = found(spark, "a http://X.example/p). ws://w/1;\nhttp://localhost/x postgres://h/d\r\nhttp://X.example/p http://X.example/p")
    assert [(u["url"], u["line"]) for u in urls] == [("http://X.example/p", 1), ("ws://w/1", 1), ("http://X.example/p", 3)]


def test_languages(spark):
    names = {"a/b.PY": "python", ".env": "env", "x/.env.local": "env", "prod.env": "env", "Makefile": "bash", "CMakeLists.txt": "cpp", "compose.yml": "yaml", "Dockerfile": "dockerfile", "x.tar.gz": None, "none": None, ".bashrc": None, "a.tfvars": "terraform"}
    assert [r[0] for r in applied(spark, list(names), L.detect_language)] == list(names.values())
    from sluice.sources.repository import language_of

    assert [language_of(n.rpartition("/")[2]) for n in names] == list(names.values())
    assert L.language_filter("JS, k8s,,foo") == {"javascript", "kubernetes", "foo"}
    assert ".yml" in L.suffixes_for({"k8s"}) and L.suffixes_for(set()) is None and L.suffixes_for({"dockerfile"}) is not None


def test_names(spark):
    long = "d/" * 120 + "x.py"
    out = [r[0] for r in applied(spark, ["a/b.c", long, long + "2"], T.document_name)]
    assert out[0] == "a_b_c.md" and len(out[1]) == len(out[2]) == 180 and out[1] != out[2]
    assert [r[0] for r in applied(spark, ["a:b?", "///"], T.plain_name)] == ["ab", "unnamed"]
    assert [r[0] for r in applied(spark, ["https://x/owner/repo.git/", "https://x/owner/repo.git"], T.repository_slug)] == ["owner-repo", "owner-repo"]
    assert [r[0] for r in applied(spark, ['"""Doc."""', "'x'", "y"], T.strip_quotes)] == ["Doc.", "x", "y"]
    assert [r[0] for r in applied(spark, ["a==1", "b[x]>=2", "# c", "-r d", "", "e"], T.requirement_name)] == ["a", "b", None, None, None, "e"]
