"""Many documents as one text, and its measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import human_size, token_estimate, word_count


def bundles(parts: DataFrame, key: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """(key, bundle): the texts of each key in order, right-trimmed, with a line end after the last."""
    piece = F.rtrim(F.col(text), F.lit(" \t\r\n"))
    held = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("t")))).alias("p"))
    return held.select(key, F.concat(F.array_join("p.t", separator), F.lit("\n")).alias("bundle"))


def measures(text: Column) -> list[Column]:
    size = F.octet_length(text).cast("long")
    return [F.length(text).cast("long").alias("characters"), word_count(text).alias("words"), size.alias("bytes"), human_size(size).alias("size_human"), token_estimate(F.length(text)).alias("tokens_estimate")]
