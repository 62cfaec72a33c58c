"""Shared pieces of the training-data operators: storage, batching and word hashing.

Texts are handled as whole Arrow batches of code points, so that the work per
character is a handful of vectorised numpy steps instead of Python objects.
"""

from __future__ import annotations

import math
import os
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
#: All code points are below this.
TOP = 0x110000
#: Characters that are worked on at once; a longer text is a chunk of its own.
CHUNK_CHARS = 1 << 18
#: A table of at most this many bytes may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Bytes of records that a task works on at once after a packed exchange.
PART_BYTES = 32 << 20
#: With it, Spark deletes the shuffle files of a query when that ends, not when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# ---------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none (local tests) is a temporary one set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="sluice-")
            spark.sparkContext.setCheckpointDir(at)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path for a table of this application in the shared folder."""
    return f"{shared_dir(spark)}/sluice-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors.

    The shuffle files of its making go at once (under adaptive execution; without it Spark keeps them
    until the driver collects garbage), so those of several tables don't add up on the disks.
    """
    spark = df.sparkSession
    path, was = fresh_path(spark, name), spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if was is None else spark.conf.set(SHUFFLE_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._written_at)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application has left in the shared folder; results that read them end with them."""
    _delete(spark, f"{shared_dir(spark)}/sluice-{spark.sparkContext.applicationId}")


def filesystem(uri: str):
    """(file system, path) of a folder that Spark names, for reading and writing in Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def fresh(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if ``rows`` of ``row_bytes`` stay under ``limit``; else Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


# ---------------------------------------------------------------- batches


def slices(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``most`` bytes together."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values evenly."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


@lru_cache(1)
def word_table() -> np.ndarray:
    """Code point -> its lower-case form for letters, marks and digits; 0 for all else.

    A letter whose lower case is longer than one character stays as it is. No plane between the
    third and the fourteenth has a character.
    """
    table = np.zeros(TOP, np.uint32)
    for c in (*range(0x40000), *range(0xE0000, 0xE0200)):
        if unicodedata.category(chr(c))[0] in "LNM":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@lru_cache(1)
def char_values() -> np.ndarray:
    return mix(np.arange(1, TOP + 1, dtype=U64) * U64(0xD1B54A32D192ED03))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, U64), np.full(n, inverse, U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each."""
    return _powers(1 << max(19, int(n).bit_length()))


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Sums p with p[j] - p[i] = the polynomial hash of values[i:j], times base ** i."""
    up, _ = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def normalised(codes: np.ndarray) -> np.ndarray:
    table = word_table()
    out = table[np.minimum(codes, TOP - 1)]
    return out


class Words:
    """The words of a list of texts: runs of letters, marks and digits in lower case.

    ``start``/``end`` are offsets in the joined code points, ``doc`` the text a word
    is in, ``hash`` its 64-bit hash, ``length`` its characters, ``first[d]:first[d+1]``
    the words of text d. ``base[d]`` is where text d starts.
    """

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        codes = code_points(joined)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.concatenate([[0], np.cumsum(size + 1)])[: len(texts)]
        self.norm = normalised(codes)
        inside = self.norm != 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        self.start, self.end = edge[::2], edge[1::2]
        self.length = self.end - self.start
        self.doc = np.searchsorted(self.base, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self._sums = prefix_hashes(np.where(inside, char_values()[np.minimum(self.norm, TOP - 1)], U64(0)))
        _, self._down = powers(len(codes) + 1)
        self.hash = mix((self._sums[self.end] - self._sums[self.start]) * self._down[self.start])

    def heads(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(words of more than k characters, hashes of their first k characters)."""
        longer = np.flatnonzero(self.length > k)
        at = self.start[longer]
        return longer, mix((self._sums[at + k] - self._sums[at]) * self._down[at] + U64(k))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


# ---------------------------------------------------------------- tokenizer


TOKENIZER_DIR = os.environ.get("SLUICE_TOKENIZERS", "/opt/tokenizers")
PRETOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def tokenizer(path: str):
    """A byte-level BPE from a ranks file: ``base64 rank`` on each line."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PRETOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={})


DEFAULT_RANKS = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"


def encode(bpe, text: str) -> np.ndarray:
    """Token ids of a text; lone surrogates are replaced as in the tokenizer itself."""
    try:
        return np.frombuffer(bpe._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32)
    except UnicodeEncodeError:
        return np.array(bpe.encode_ordinary(text), np.uint32)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_text(work, texts: pa.Array, kind: type) -> np.ndarray:
    """``work(list of texts)``, an array for each part of a column, as one array; null texts are empty."""
    out = [work(texts_of(part)) for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]))]
    return np.concatenate([*out, np.empty(0, kind)])


# ---------------------------------------------------------------- packed exchange


def plan_bytes(df: DataFrame) -> int:
    """The size of ``df`` as the optimizer estimates it from its files; 0 where it can't."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def partitions(df: DataFrame, growth: float = 1.0, most: int = PART_BYTES) -> int:
    """Partitions for ``growth`` times the bytes of ``df``, ``spark.sql.shuffle.partitions`` at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(plan_bytes(df) * growth / most))


def packed_exchange(df: DataFrame, emit, width: int, flush_rows: int = 1 << 20, growth: float = 1.0, route=None) -> DataFrame:
    """Shuffle fixed-width records in binary blocks instead of rows.

    ``emit(record batch)`` yields int64 arrays of shape (n, width) whose first column is the
    key; records of equal key end in the same partition of the result, (part, data), or those
    for which ``route(records)``, 64-bit hashes, is equal. Millions of small records then cost
    their own bytes and no object or row each. Records that repeat within a block are sent once,
    so that a key of many copies doesn't weigh more than its different records. The partitions
    follow the data (``growth`` is the records' size in sizes of ``df``); read them with
    :func:`each_partition`.
    """
    count = partitions(df, growth)

    def blocks(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        part = (route(rows) if route else mix(rows[:, 0].view(U64))) % U64(count)
        whole = rows[:, 0].view(U64)
        for k in range(1, width):
            whole = mix(whole) ^ rows[:, k].view(U64)
        # Repeats are found by hash; what is left keeps its order, in which neighbours are alike and pack well.
        order = np.argsort(mix(whole))
        kept = rows[order]
        kept = np.sort(order[np.concatenate([[True], (kept[1:] != kept[:-1]).any(axis=1)])])
        rows, part = rows[kept], part[kept].astype(np.int64 if count > 1 << 16 else np.uint16)
        order = np.argsort(part, kind="stable")
        rows, part = rows[order], part[order]
        ids, first = np.unique(part, return_index=True)
        ends = [*first[1:], len(part)]
        data = [rows[a:b].tobytes() for a, b in zip(first, ends)]
        return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(data, pa.binary())], ["part", "data"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for rows in emit(batch):
                if len(rows):
                    held.append(np.ascontiguousarray(rows, np.int64).reshape(-1, width))
                    n += len(held[-1])
                    if n >= flush_rows:
                        yield blocks(held)
                        held, n = [], 0
        if held:
            yield blocks(held)

    return df.mapInArrow(run, "part int, data binary").repartitionById(count, "part")


def each_partition(exchanged: DataFrame, work, width: int, schema: str) -> DataFrame:
    """``work(int64 array (n, width) of a whole partition)`` yields record batches of ``schema``."""

    def run(batches):
        held = [np.frombuffer(x, np.int64).reshape(-1, width) for batch in batches for x in batch.column("data").to_pylist()]
        if held:
            yield from work(np.concatenate(held))

    return exchanged.mapInArrow(run, schema)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values in a sorted array."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return first, np.append(first[1:], len(keys))


def run_pairs(start: np.ndarray, end: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions i < j within each run, about ``most`` pairs at once."""
    for a, b in zip(start, end):
        rows = max(1, most // (b - a))
        for i in range(a, b - 1, rows):
            left = np.arange(i, min(i + rows, b - 1))
            right = b - 1 - left
            l = np.repeat(left, right)
            offset = np.arange(len(l)) - np.repeat(np.cumsum(right) - right, right)
            yield l, l + 1 + offset
