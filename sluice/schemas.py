"""Row types of the library; nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


STRINGS = T.ArrayType(S)
FUNCTION = _struct(name=S, signature=S, docstring=S, decorators=STRINGS, is_method=B, parent_class=S, line_start=I, line_end=I, internal_calls=STRINGS)
CLASS = _struct(name=S, docstring=S, bases=STRINGS, decorators=STRINGS, methods=T.ArrayType(FUNCTION), line_start=I, line_end=I)
CALL = _struct(pattern=S, line=I, context=S)
URL = _struct(url=S, line=I, context=S)
ENDPOINT = _struct(connection_type=S, host=S, port=S, user=S, schema=S, database=S, line=I, context=S, raw_redacted=S)

FILE = _struct(path=S, size=L, mtime_ns=L, content=S)
#: What the parsers find in one file.
SYMBOLS = _struct(language=S, module_docstring=S, imports=STRINGS, exports=STRINGS, classes=T.ArrayType(CLASS), functions=T.ArrayType(FUNCTION), external_calls=T.ArrayType(CALL), error=S)
PARSED = T.StructType([T.StructField("path", S), T.StructField("size", L), T.StructField("mtime_ns", L), T.StructField("content_sha256", S), *SYMBOLS.fields, T.StructField("external_urls", T.ArrayType(URL)), T.StructField("database_endpoints", T.ArrayType(ENDPOINT))])
