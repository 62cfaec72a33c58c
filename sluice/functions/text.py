"""Column functions on single values: redaction, connection strings, names and sizes.

All are built-in Spark expressions: no row goes through Python, and their filters reach the scan.
Those made with :func:`let` are higher-order functions, which Spark evaluates without generated code.
A null input gives a null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

BLANKS = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def redact_secrets(c: Column) -> Column:
    """Passwords in connection strings and after secret keys become ``***``."""
    c = F.regexp_replace(c, P.USER_PASSWORD, "://$1***@")
    c = F.regexp_replace(c, P.PASSWORD, "://:***@")
    return F.regexp_replace(c, P.SECRET, "$1=***")


def context(line: Column, size: int = 160) -> Column:
    """The stripped start of a line, with secrets redacted (raw text is never kept)."""
    return F.substring(redact_secrets(strip(line)), 1, size)


def clean_url(c: Column) -> Column:
    return F.rtrim(c, F.lit(".,;)"))


def url_host(url: Column) -> Column:
    """The host in lower case; null without one."""
    return empty_to_null(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)))


def connection_type(value: Column) -> Column:
    low = F.lower(value)
    out = F.lit("generic")
    for t in reversed(P.TYPES):
        out = F.when(F.contains(low, F.lit(t)), F.lit("postgres" if t == "postgresql" else t)).otherwise(out)
    return F.when(value.isNotNull(), out)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _connection(kind: Column, **fields: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(kind.alias("connection_type"), *[fields.get(f, none).alias(f) for f in ("host", "port", "user", "schema", "database")])


def _jdbc(raw: Column) -> Column:
    part = lambda g: empty_to_null(F.regexp_extract(raw, P.JDBC_PARTS, g))
    return _connection(F.lit("jdbc"), host=part(1), port=part(2), database=part(3))


def _uri(raw: Column) -> Column:
    split = lambda g: F.regexp_extract(raw, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", g)

    def fields(p: Column) -> Column:
        host = empty_to_null(F.lower(F.regexp_extract(p["at"], r"^\[?([^:\]]*)", 1)))
        port = F.regexp_extract(p["at"], r":([0-9]+)$", 1)
        number = F.when(port != "", port.cast("decimal(38,0)"))
        user = F.when(F.contains(p["place"], F.lit("@")), empty_to_null(F.regexp_extract(p["place"], r"^([^:@]*)", 1)))
        schema = empty_to_null(F.regexp_extract(p["query"], r"(?:^|&)schema=([^&]+)", 1))
        database = empty_to_null(F.ltrim(p["path"], F.lit("/")))
        whole = lambda n: _connection(connection_type(raw), host=host, port=F.when(n > 0, n.cast("string")), user=user, schema=schema, database=database)
        return let(number, lambda n: F.when(n.isNull() | (n <= 65535), whole(n)).otherwise(_connection(connection_type(raw), host=host)))

    placed = let(split(1), lambda place: F.struct(place.alias("place"), F.regexp_replace(place, r"^.*@", "").alias("at"), split(2).alias("path"), split(3).alias("query")))
    return let(placed, fields)


def parse_connection(value: Column) -> Column:
    """struct(connection_type, host, port, user, schema, database) of a connection string.

    Null for placeholders. An invalid port leaves only type and host.
    """
    given = lambda raw: (raw != "") & ~raw.isin(*P.PLACEHOLDERS)
    return let(F.btrim(strip(value), F.lit("\"'")), lambda raw: F.when(given(raw), F.when(raw.startswith("jdbc:"), _jdbc(raw)).otherwise(_uri(raw))))


def document_name(path: Column, limit: int = 180, digits: int = 12) -> Column:
    """File name of a rendered document; long names end in a piece of the path's SHA-1."""
    safe = F.translate(F.regexp_replace(path, r"[^A-Za-z0-9_./-]", "_"), "/.", "__")
    tail = F.concat(F.lit("__"), path_digest(path, digits), F.lit(".md"))
    return F.when(F.length(safe) + 3 <= limit, F.concat(safe, F.lit(".md"))).otherwise(F.concat(F.substring(safe, 1, limit - digits - 5), tail))


def path_digest(path: Column, digits: int = 12) -> Column:
    return F.substring(F.sha1(F.encode(path, "utf-8")), 1, digits)


def plain_name(name: Column) -> Column:
    """A name without separators and control characters; ``unnamed`` if nothing is left."""
    return F.coalesce(empty_to_null(F.regexp_replace(name, r"[/\\:*?\x00-\x1f]", "")), F.lit("unnamed"))


def human_size(n: Column) -> Column:
    kb, mb = F.lit(1024.0), F.lit(1024.0 * 1024)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", F.bround(n / kb, 1)), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.2f", F.bround(n / mb, 2)), F.lit(" MB")))


def token_estimate(characters: Column) -> Column:
    return F.floor(characters / 4).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), 0)).cast("long")


def tail_of_path(path: Column, limit: int) -> Column:
    """The end of a path that fits ``limit``, after an ellipsis where something is cut."""
    return F.when(F.length(path) <= limit, path).otherwise(F.concat(F.lit("…"), F.right(path, F.lit(limit - 1))))


def repository_slug(url: Column) -> Column:
    """The last two segments of a repository's URL, joined by ``-``."""
    segments = F.filter(F.split(F.regexp_replace(F.rtrim(url, F.lit("/")), r"\.git$", ""), "/"), lambda s: s != "")
    return F.array_join(F.slice(segments, F.greatest(F.lit(1), F.size(segments) - 1), 2), "-")


def strip_quotes(c: Column) -> Column:
    """A docstring without its quotes."""
    out = strip(c)
    cut = lambda q: F.when(out.startswith(q) & out.endswith(q) & (F.length(out) >= 2 * len(q)), strip(F.substring(out, F.lit(len(q) + 1), F.length(out) - 2 * len(q))))
    return F.coalesce(cut('"""'), cut("'''"), cut('"'), cut("'"), out)


def signature(language: Column, name: Column, params: Column, result: Column) -> Column:
    """A function's signature as its language writes it."""
    params = F.coalesce(params, F.lit("()"))
    arrow = F.coalesce(F.concat(F.lit(" -> "), result), F.lit(""))
    colon = F.coalesce(F.concat(F.lit(": "), result), F.lit(""))
    blank = F.coalesce(F.concat(F.lit(" "), result), F.lit(""))
    styles = [("python", "def ", arrow), ("javascript", "function ", colon), ("typescript", "function ", colon), ("go", "func ", blank), ("rust", "fn ", arrow)]
    other = F.concat(name, params, colon)
    return reduce(lambda out, s: F.when(language == s[0], F.concat(F.lit(s[1]), name, params, s[2])).otherwise(out), styles, other)


def requirement_name(line: Column) -> Column:
    """The package of a requirements line; null for blanks, comments and options."""
    line = strip(line)
    name = strip(F.regexp_extract(line, r"^(.*?)(?:==|>=|<=|\[|$)", 1))
    return F.when(~F.substring(line, 1, 1).isin("#", "-"), empty_to_null(name))
