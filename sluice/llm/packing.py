"""Operator 4, best-fit packing: bounded-space online best fit.

Documents arrive as token sequences, each with one end mark, and are put in bins of
``capacity`` tokens. A sequence of at least ``capacity`` tokens first fills whole bins of its
own; what is left of it is one piece. A piece goes to the open bin with the least free space
that holds it. At most ``open_bins`` bins are open: a bitset keyed by free space finds the best
fit with one shift and its lowest bit, and when a new bin is needed beyond the bound, the
fullest open bin, the bitset's lowest bit, closes first. Bins of equal free space are taken
in the order in which they reached it.

The stream is split by hash of ``doc_id`` into shards of about ``shard_tokens`` tokens that are
packed side by side; within a shard documents arrive in order of ``doc_id``. The split depends
on the total number of tokens alone, not on the cluster.

Cases: null text or id, and texts without a token, have no piece; rows with the same ``doc_id``
are each packed, those with fewer tokens first; texts of any length are encoded whole; the
result of an empty table is empty. Other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DEFAULT_RANKS, documents, encode, slices, texts_of, tokenizer, written

CAPACITY = 2048
OPEN_BINS = 64
SHARD_TOKENS = 1 << 24
PIECES = "shard int, bin long, slot int, doc_id long, start long, length int"


class Packer:
    """Best fit over a bounded number of open bins."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.at = 0, defaultdict(deque)
        self.slots: dict[int, int] = {}
        self.bins = 0

    def _take(self, free: int) -> int:
        queue = self.at[free]
        b = queue.popleft()
        if not queue:
            self.bits &= ~(1 << free)
        return b

    def add(self, length: int):
        """(bin, slot, start, length) of each piece of a sequence."""
        full, rest = divmod(length, self.capacity)
        for k in range(full):
            yield self.bins, 0, k * self.capacity, self.capacity
            self.bins += 1
        if not rest:
            return
        fits = self.bits >> rest
        if fits:
            free = rest + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if len(self.slots) >= self.open_bins:
                self.slots.pop(self._take((self.bits & -self.bits).bit_length() - 1))
            b, free = self.bins, self.capacity
            self.bins += 1
            self.slots[b] = 0
        yield b, self.slots[b], full * self.capacity, rest
        self.slots[b] += 1
        if free == rest:
            del self.slots[b]
        else:
            self.at[free - rest].append(b)
            self.bits |= 1 << (free - rest)


def token_lengths(docs: DataFrame, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, tokens): the tokens of each whole text."""

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                n = np.fromiter((len(encode(tokenizer(ranks), t)) for t in texts_of(part)), np.int64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n)], ["doc_id", "tokens"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return read.mapInArrow(count, "doc_id long, tokens long")


def pack(lengths: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(shard, bin, slot, doc_id, start, length) from (doc_id, tokens); bins are numbered in a shard."""
    lengths = written(lengths.where("tokens > 0").select("doc_id", (F.col("tokens") + 1).alias("tokens")), "token-lengths")
    total = lengths.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_tokens))
    placed = lengths.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    placed = placed.repartition("shard").sortWithinPartitions("shard", "doc_id", "tokens")

    def run(batches):
        now, packer = None, None
        for batch in batches:
            out = []
            for doc, tokens, shard in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tokens", "shard"))):
                if shard != now:
                    now, packer = shard, Packer(capacity, open_bins)
                out += [(shard, b, slot, doc, start, length) for b, slot, start, length in packer.add(tokens)]
            if out:
                cols = list(zip(*out))
                types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["shard", "bin", "slot", "doc_id", "start", "length"])

    return placed.mapInArrow(run, PIECES)


def packed_documents(docs: DataFrame, ranks: str = DEFAULT_RANKS, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    return pack(token_lengths(docs, ranks), capacity, open_bins, shard_tokens)


def query(spark, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))
