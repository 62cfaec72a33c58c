"""URLs and database endpoints in source text.

Everything is an expression over one line: duplicates are defined within a line, so they are
removed inside its array, and the whole extraction is one narrow projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import clean_url, context, let, parse_connection, redact_secrets, strip, url_host

FIELDS = ("connection_type", "host", "port", "user", "schema", "database")


def split_lines(text: Column, end: str = P.LINE_END) -> Column:
    """Array of lines as Python's ``splitlines`` gives it: no element after a final line end. ``end`` is a pattern."""
    return let(F.split(text, end), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def lines(files: DataFrame, key: str = "path", content: str = "content", end: str = P.LINE_END) -> DataFrame:
    """(key, line_no, line), line numbers from 1."""
    out = files.select(key, F.posexplode(split_lines(F.col(content), end)).alias("pos", "line"))
    return out.select(key, (F.col("pos") + 1).alias("line_no"), "line")


def may_hold_endpoint(line: Column) -> Column:
    """A cheap test that every line with an endpoint or URL passes."""
    return line.rlike(r"[=:{}]") | F.lower(line).rlike("http|db_|host")


def _endpoint(about: Column, raw: Column, branch: str, **fields: Column) -> Column:
    """about: struct(line, line_no, context)."""
    text = F.lit(None).cast("string")
    return F.struct(
        *[fields.get(f, text).cast("string").alias(f) for f in FIELDS],
        about["line_no"].cast("int").alias("line"),
        about["context"].alias("context"),
        redact_secrets(raw).alias("raw_redacted"),
        F.lit(branch).alias("branch"),
    )


def _about(line: Column, line_no: Column, use) -> Column:
    return let(F.struct(line.alias("line"), line_no.alias("line_no"), context(line).alias("context")), use)


def _variable(line: Column) -> Column:
    """struct(name, value) of a line that sets a variable; empty strings for any other."""
    value = strip(F.btrim(strip(F.regexp_extract(strip(line), P.ENV_LINE, 2)), F.lit("\"'")))
    return F.struct(F.upper(F.regexp_extract(strip(line), P.ENV_LINE, 1)).alias("name"), value.alias("value"))


def _handled(variable: Column) -> Column:
    return variable["name"].isin(*P.ENV_NAMES) & (variable["value"] != "")


def env_handled(line: Column) -> Column:
    """Whether the line sets one of the known variables to something."""
    return let(_variable(line), _handled)


def _env(about: Column, variable: Column) -> Column:
    name, value = variable["name"], variable["value"]
    raw = F.concat(name, F.lit("="), value)
    uri = let(parse_connection(value), lambda p: F.when(p.isNotNull(), _endpoint(about, value, "uri", **{f: p[f] for f in FIELDS})))
    part = lambda branch, field: _endpoint(about, raw, branch, connection_type=F.lit("env"), **{field: value})
    by_name = (
        F.when(F.contains(value, F.lit("://")) | name.rlike("_UR[LI]$"), uri)
        .when(name.rlike("_HOST$|^PGHOST$"), part("env", "host"))
        .when(name.rlike("_USER(NAME)?$|^PGUSER$"), part("env", "user"))
        .when(name.rlike("_(DATABASE|NAME|DB)$|^PGDATABASE$"), part("env", "database"))
        .when(name.rlike("_SCHEMA$"), part("env", "schema"))
        .when(name.rlike("_PORT$|^PGPORT$"), part("env", "port"))
    )
    return F.when(_handled(variable), by_name)


def env_endpoint(line: Column, line_no: Column) -> Column:
    """struct or null: a known variable, read by its name and the shape of its value."""
    return _about(line, line_no, lambda about: let(_variable(line), lambda v: _env(about, v)))


def _value(line: Column, pattern: str) -> Column:
    return let(F.btrim(strip(F.regexp_extract(line, pattern, 1)), F.lit("\"'")), lambda v: F.when((v != "") & ~v.isin(*P.PLACEHOLDERS), v))


def _key_value(about: Column) -> Column:
    line = about["line"]
    found = F.struct(*[F.coalesce(_value(line, P.DICT_VALUE[f]), _value(line, P.KEY_VALUE[f])).alias(f) for f in FIELDS[1:]])
    row = lambda f: _endpoint(about, strip(line), "config", connection_type=F.lit("config"), **{n: f[n] for n in FIELDS[1:]})
    return F.when(~F.contains(line, F.lit("://")), let(found, lambda f: F.when(F.coalesce(*[f[n] for n in FIELDS[1:]]).isNotNull(), row(f))))


def key_value_endpoint(line: Column, line_no: Column) -> Column:
    """struct or null: host, port and so on given by key, all of a line in one row.

    Values of quoted dictionary keys come before those of bare keys.
    """
    return _about(line, line_no, _key_value)


def _connections(about: Column, pattern: str, group: int = 0) -> Column:
    def one(raw: Column) -> Column:
        return let(parse_connection(raw), lambda p: F.when(p.isNotNull(), _endpoint(about, F.btrim(strip(raw), F.lit("\"'")), "uri", **{f: p[f] for f in FIELDS})))

    return F.transform(F.regexp_extract_all(about["line"], F.lit(pattern), F.lit(group)), one)


def _driver(about: Column) -> Column:
    called = about["line"].rlike(r"create_engine|connect\(|createConnection")
    return F.when(called, _connections(about, P.DRIVER, 1)).otherwise(F.array().cast(_row_type()))


def uri_endpoints(line: Column, line_no: Column) -> Column:
    return _about(line, line_no, lambda about: _connections(about, P.CONNECTION))


def jdbc_endpoints(line: Column, line_no: Column) -> Column:
    return _about(line, line_no, lambda about: _connections(about, P.JDBC))


def driver_endpoints(line: Column, line_no: Column) -> Column:
    """Strings given to a driver's connect call; the words are looked for in their own case first."""
    return _about(line, line_no, _driver)


def _row_type() -> str:
    return "array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ",line:int,context:string,raw_redacted:string,branch:string>>"


def _first_of_each(every: Column) -> Column:
    same = lambda a, b: a["host"].eqNullSafe(b["host"]) & a["user"].eqNullSafe(b["user"]) & a["database"].eqNullSafe(b["database"]) & a["port"].eqNullSafe(b["port"])
    return F.filter(every, lambda e, i: (e["branch"] == "env") | ~F.exists(F.slice(every, F.lit(1), i), lambda o: (o["branch"] != "env") & same(o, e)))


def line_endpoints(line: Column, line_no: Column) -> Column:
    """All endpoints of a line, the first of each (host, user, database, port) only.

    Parts from single variables other than a host's don't take part in the comparison.
    """

    def found(about: Column) -> Column:
        env = let(_variable(about["line"]), lambda v: F.array(_env(about, v), F.when(~_handled(v), _key_value(about))))
        return F.filter(F.concat(env, _connections(about, P.CONNECTION), _connections(about, P.JDBC), _driver(about)), lambda e: e.isNotNull())

    return F.when(may_hold_endpoint(line), let(_about(line, line_no, found), _first_of_each)).otherwise(F.array().cast(_row_type()))


def line_urls(line: Column) -> Column:
    """The distinct URLs of a line, without connection strings and local hosts."""
    found = F.transform(F.regexp_extract_all(line, F.lit(P.URL), 0), clean_url)
    kept = F.filter(found, lambda u: ~F.coalesce(url_host(u).isin(*P.LOCAL_HOSTS), F.lit(False)))
    return F.when(F.lower(line).rlike("http|ftp://|wss?://"), F.array_distinct(kept)).otherwise(F.array().cast("array<string>"))


def endpoints(line_table: DataFrame, key: str = "path") -> DataFrame:
    """(key, connection_type, host, ..., raw_redacted) from (key, line_no, line)."""
    gated = line_table.where(may_hold_endpoint(F.col("line")))
    return gated.select(key, F.inline(line_endpoints(F.col("line"), F.col("line_no")))).drop("branch")


def urls(line_table: DataFrame, key: str = "path") -> DataFrame:
    """(key, url, line, context) from (key, line_no, line)."""
    gated = line_table.where(F.lower("line").rlike("http|ftp://|wss?://"))
    return gated.select(key, F.explode(line_urls(F.col("line"))).alias("url"), F.col("line_no").alias("line"), context(F.col("line")).alias("context"))


def text_endpoints(text: Column) -> Column:
    """array<endpoint> of a whole text, in line order."""
    numbered = F.filter(F.transform(split_lines(text), lambda l, i: F.struct(l.alias("l"), (i + 1).alias("n"))), lambda s: may_hold_endpoint(s["l"]))
    found = F.flatten(F.transform(numbered, lambda s: line_endpoints(s["l"], s["n"])))
    return F.transform(found, lambda e: F.struct(*[e[f].alias(f) for f in (*FIELDS, "line", "context", "raw_redacted")]))


def text_urls(text: Column) -> Column:
    """array<url> of a whole text, in line order."""
    numbered = F.transform(split_lines(text), lambda l, i: F.struct(l.alias("l"), (i + 1).cast("int").alias("n")))
    found = F.flatten(F.transform(numbered, lambda s: F.transform(line_urls(s["l"]), lambda u: F.struct(u.alias("url"), s["n"].alias("line"), context(s["l"]).alias("context")))))
    return F.when(F.lower(text).rlike("http|ftp://|wss?://"), found).otherwise(F.array().cast("array<struct<url:string,line:int,context:string>>"))
