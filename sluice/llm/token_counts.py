"""Operator 7, token counts: overlap resynchronisation of huge documents.

Texts of at most ``chunk + overlap`` characters are encoded whole. A longer one is cut into
chunks that overlap, which are encoded side by side in any task. Each chunk yields the number
of tokens up to every boundary of a pre-token (a match of the tokenizer's splitting pattern)
within its overlaps; tokens never cross such a boundary.

A common boundary is proven to be one of the whole text. The pattern looks at no character
before a match, so what follows a boundary depends on its place alone: once the chunk on the
right has a boundary where the left one has a true one, both go on alike. A match of the left
chunk is true if it can't have been changed by the chunk's end, that is if it ends ``MARGIN``
characters or more before it: a match ends where a character doesn't fit, and looks at no
more than two characters beyond the shortest one. By induction from the start of the text all
splices are exact. Where a pair of chunks has no common boundary (a run of letters longer than
the overlap), that document is done again with a wider overlap, at last as a whole.

Cases: null text or id gives no row, an empty text 0 tokens; rows of the same ``doc_id`` with
equal counts are one row; texts of any length are counted exactly. Other columns are not looked
at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import DEFAULT_RANKS, PRETOKEN_PATTERN, documents, encode, slices, texts_of, tokenizer, written

CHUNK = 32_768
OVERLAP = 512
WIDER = 8
MARGIN = 4


@lru_cache(1)
def _pattern():
    import regex

    return regex.compile(PRETOKEN_PATTERN)


@lru_cache(2)
def _token_bytes(ranks: str) -> np.ndarray:
    bpe = tokenizer(ranks)
    return np.fromiter((len(bpe.decode_single_token_bytes(i)) for i in range(bpe.n_vocab)), np.int64, bpe.n_vocab)


def boundaries(text: str, ranks: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(tokens, character offsets of all pre-token boundaries, 0 included, tokens before each)."""
    ids = encode(tokenizer(ranks), text)
    ends = np.fromiter((m.end() for m in _pattern().finditer(text)), np.int64)
    ends = np.concatenate([[0], ends])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.concatenate([[0], np.cumsum(size)])[ends]
    before = np.concatenate([[0], np.cumsum(_token_bytes(ranks)[ids])])
    return len(ids), ends, np.searchsorted(before, at)


def _whole(docs: DataFrame, ranks: str) -> DataFrame:
    def count(batches):
        for batch in batches:
            for part in slices(batch):
                n = [len(encode(tokenizer(ranks), t)) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_tokens long")


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    n = F.length("text")
    last = F.greatest(F.lit(0), F.ceil((n - overlap) / F.lit(chunk)).cast("int") - 1)
    cut = docs.select("doc_id", "key", "text", F.explode(F.sequence(F.lit(0), last)).alias("i"), last.alias("last"))
    return cut.select("doc_id", "key", "i", "last", F.substring("text", F.col("i") * chunk + 1, F.lit(chunk + overlap)).alias("text")).repartition("doc_id", "key", "i")


def _encoded(chunks: DataFrame, chunk: int, overlap: int, ranks: str) -> DataFrame:
    """Per chunk its tokens and the boundaries in its overlaps, as offsets from the chunk's start and the next one's."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for i, last, text in zip(part.column("i").to_pylist(), part.column("last").to_pylist(), texts_of(part)):
                    total, ends, before = boundaries(text, ranks)
                    left = (ends < overlap) if i else ends < 0
                    right = (ends >= chunk) & (ends <= len(text) - MARGIN) if i < last else ends < 0
                    rows.append((total, ends[left], before[left], ends[right] - chunk, before[right]))
                columns = list(zip(*rows))
                kinds = [pa.int64()] + [pa.list_(pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), part.column("i")] + [pa.array([c if np.isscalar(c) else c.tolist() for c in col], k) for col, k in zip(columns, kinds)], ["doc_id", "key", "i", "n", "left", "left_n", "right", "right_n"])

    lists = ", ".join(f"{c} array<long>" for c in ("left", "left_n", "right", "right_n"))
    return chunks.mapInArrow(run, f"doc_id long, key long, i int, n long, {lists}")


def spliced(docs: DataFrame, chunk: int, overlap: int, ranks: str) -> DataFrame:
    """(doc_id, key, n_tokens): null where a pair of chunks has no proven common boundary."""
    then = Window.partitionBy("doc_id", "key").orderBy("i")
    pairs = _encoded(_chunks(docs, chunk, overlap), chunk, overlap, ranks)
    pairs = pairs.withColumn("next_left", F.lead("left").over(then)).withColumn("next_n", F.lead("left_n").over(then))
    at = F.array_min(F.array_intersect("right", "next_left"))
    value = lambda values, places: F.element_at(values, F.array_position(places, F.col("at")).cast("int"))
    pairs = pairs.withColumn("at", at)
    # What the left chunk has beyond the splice, and the right one before it, counts twice or not at all.
    twice = F.when(F.col("next_left").isNull(), F.lit(0)).otherwise(F.col("n") - value(F.col("right_n"), F.col("right")) + value(F.col("next_n"), F.col("next_left")))
    out = pairs.groupBy("doc_id", "key").agg(F.sum(F.col("n") - twice).alias("n"), F.max((F.col("next_left").isNotNull() & F.col("at").isNull()).cast("int")).alias("failed"))
    return out.select("doc_id", "key", F.when(F.col("failed") == 0, F.col("n")).alias("n_tokens"))


def token_counts(docs: DataFrame, ranks: str = DEFAULT_RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens) of every document."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    out = _whole(read.where(F.length("text") <= chunk + overlap), ranks)
    huge = read.where(F.length("text") > chunk + overlap).withColumn("key", F.xxhash64("text")).dropDuplicates(["doc_id", "key"])
    while True:
        found = written(spliced(huge, chunk, overlap, ranks), "token-splices")
        out = out.unionByName(found.where("n_tokens is not null").select("doc_id", "n_tokens"))
        failed = found.where("n_tokens is null").select("doc_id", "key")
        if failed.isEmpty():
            return out.distinct()
        huge = huge.join(failed, ["doc_id", "key"], "left_semi")
        # The overlap stays within a chunk, so that splices follow each other.
        overlap *= WIDER
        chunk = max(chunk, overlap)


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
