"""Operator 6, media columns: chroma audio fingerprints and alignment of recordings.

A recording is a binary column: a WAV file of 16-bit PCM. Its fingerprint is a row of packed
32-bit integers. Windowed spectra are folded into 12 pitch classes a frame; an integral image
over (frame, pitch class) gives every rectangle sum in four look-ups; 16 filters compare
rectangles within a window of ``WINDOW`` frames, and each is quantised to two bits (in Gray
code, so that neighbouring levels differ in one bit).

Two recordings are aligned if the share of unequal bits is at most ``MAX_ERROR`` at some offset
with ``LEAST_OVERLAP`` common steps or more. Of such offsets the histogram of equal integers
decides: the one with the most of them is the alignment (offsets at most ``NEAR_OFFSETS`` steps
apart count together), then the one with the least error, then the nearest to 0.

The search takes stated recordings as queries, against all recordings. Recordings of equal
fingerprints are one class, which its smallest id stands for. Every query is compared with every
class at every offset, so that no alignment is missed: no probe by equal integers would be whole,
as an alignment at the limit may have no step with fewer than four unequal bits, and nearly all
unrelated pairs have steps as near as that. Bits as -1 and 1 are correlated in blocks of queries
and blocks of recordings by Fourier transform, which gives the unequal bits at all offsets at
once; what reaches the limit is counted again in bits. Blocks have bounded size, whatever
recordings are alike, so no kind of recording makes a task larger.

The tables have no audio, so :func:`tones` renders one: each value of an embedding is a note.

Cases: null ids or media and what is no 16-bit PCM WAV have no fingerprint; recordings shorter
than a window have an empty one, which aligns with nothing; several channels are averaged;
silence (no energy) is a frame of zeros and aligns with other silence, as equal steps do;
of rows that repeat an id the recording with the least fingerprint (as bytes) counts; equal recordings
are of one class; offsets of equal rank are decided by the greater one; recordings of any length are
taken whole; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, filesystem, fresh_path, written

RATE = 4_000
NOTE_SECONDS = 0.125
FRAME, HOP = 1024, 512
LOW_HZ, HIGH_HZ = 110.0, 1_760.0
WINDOW = 8
#: kind of filter, first pitch class, pitch classes, frames; and the limits of its three upper levels.
FILTERS = [(0, 0, 4, 8), (0, 4, 4, 8), (0, 8, 4, 8), (1, 0, 12, 8), (1, 2, 4, 6), (1, 6, 4, 6), (2, 0, 6, 8), (2, 6, 6, 8), (2, 3, 6, 4), (3, 0, 6, 8), (3, 6, 6, 8), (4, 0, 12, 6), (5, 0, 12, 6), (1, 0, 3, 4), (2, 8, 4, 6), (0, 2, 3, 6)]
LIMITS = (-0.08, 0.0, 0.08)
GRAY = np.array([0, 1, 3, 2], np.uint32)
MAX_ERROR = 0.15
LEAST_OVERLAP = 16
NEAR_OFFSETS = 1
#: Recordings whose id this divides are the queries of the registered search.
EVERY = 50
#: Recordings that are rendered or read at once, and samples that are transformed at once.
BATCH = 64
BATCH_SAMPLES = 1 << 18
#: Integers of a block of recordings; pairs times offsets that are correlated at once.
BLOCK = 1 << 15
TILE = 1 << 19


# ---------------------------------------------------------------- audio


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def render(values: np.ndarray, rate: int = RATE) -> np.ndarray:
    """A tone of three octaves above 220 Hz for each value, of equal length; a value's size sets the pitch."""
    n = int(rate * NOTE_SECONDS)
    pitch = np.floor(np.clip(values * 4 + 0.5, 0, 1) * 24)
    phase = np.cumsum(np.repeat(2 * np.pi * 220 * 2 ** (pitch / 12) / rate, n)) % (2 * np.pi)
    return 0.5 * np.sin(phase.astype(np.float32))


def pcm(data: bytes | None) -> tuple[np.ndarray, int] | None:
    """(samples, rate) of a WAV file of 16-bit PCM; None for anything else."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            if w.getsampwidth() != 2 or w.getcomptype() != "NONE":
                return None
            raw = w.readframes(w.getnframes())
            raw = raw[: len(raw) // (2 * w.getnchannels()) * 2 * w.getnchannels()]
            samples = np.frombuffer(raw, "<i2")
            if w.getnchannels() > 1:
                samples = samples.reshape(-1, w.getnchannels()).mean(axis=1, dtype=np.float64)
            return (samples / 32768).astype(np.float32), w.getframerate()
    except (wave.Error, EOFError):
        return None


# ---------------------------------------------------------------- fingerprint


@lru_cache(4)
def _fold(rate: int) -> np.ndarray:
    """Spectrum bin -> pitch class, as a matrix."""
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(hz), 12), np.float32)
    used = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    out[used, np.round(12 * np.log2(hz[used] / 440)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """(..., frames, 12) from (..., samples): energy of each pitch class, of unit length in each frame."""
    samples = np.asarray(samples, np.float32)
    if samples.shape[-1] < FRAME:
        return np.zeros((*samples.shape[:-1], 0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME, axis=-1)[..., ::HOP, :]
    spectrum = np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=-1)
    power = ((spectrum.real**2 + spectrum.imag**2) @ _fold(rate)).astype(np.float64)
    size = np.linalg.norm(power, axis=-1, keepdims=True)
    return np.where(size > 1e-9, power / np.maximum(size, 1e-9), 0)


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Packed integers, one for each window of frames: (..., windows) from (..., samples)."""
    image = chroma(samples, rate)
    n = image.shape[-2] - WINDOW + 1
    if n <= 0:
        return np.empty((*image.shape[:-2], 0), np.uint32)
    total = np.zeros((*image.shape[:-2], image.shape[-2] + 1, 13))
    total[..., 1:, 1:] = image.cumsum(axis=-2).cumsum(axis=-1)

    def area(t: int, frames: int, p: int, classes: int) -> np.ndarray:
        a, b = total[..., t : t + n, :], total[..., t + frames : t + frames + n, :]
        return b[..., p + classes] - a[..., p + classes] - b[..., p] + a[..., p]

    out = np.zeros((*image.shape[:-2], n), np.uint32)
    for kind, p, c, t in FILTERS:
        whole = area(0, t, p, c)
        if kind == 0:  # this band against all others
            a, b = whole, (area(0, t, 0, 12) - whole) * c / (12 - c)
        elif kind == 1:  # first half against second half
            a, b = area(0, t // 2, p, c), area(t // 2, t - t // 2, p, c)
        elif kind == 2:  # lower classes against upper ones
            a, b = area(0, t, p, c // 2), area(0, t, p + c // 2, c - c // 2)
        elif kind == 3:  # opposite quarters against the other two
            a = area(0, t // 2, p, c // 2) + area(t // 2, t - t // 2, p + c // 2, c - c // 2)
            b = whole - a
        elif kind == 4:  # the middle third in time against the rest
            a = area(t // 3, t // 3, p, c)
            b = (whole - a) / 2
        else:  # the middle classes against the rest
            a = area(0, t, p + c // 3, c // 3)
            b = (whole - a) / 2
        level = np.searchsorted(LIMITS, np.log((1 + a) / (1 + b)), side="right")
        out = (out << np.uint32(2)) | GRAY[level]
    return out


def alike(audio: list[tuple[np.ndarray, int]], most: int = BATCH_SAMPLES) -> Iterator[list[int]]:
    """Numbers of recordings of one rate and length, about ``most`` samples together."""
    by: dict[tuple[int, int], list[int]] = {}
    for k, (samples, rate) in enumerate(audio):
        by.setdefault((len(samples), rate), []).append(k)
    for (n, _), numbers in by.items():
        step = max(1, most // max(1, n))
        yield from (numbers[i : i + step] for i in range(0, len(numbers), step))


def fingerprints(media: DataFrame) -> DataFrame:
    """(id, fingerprint) from (id, media); the integers as little-endian bytes."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                read = [(k, pcm(data)) for k, data in zip(part.column("id").to_pylist(), part.column("media").to_pylist())]
                ids, audio = zip(*[r for r in read if r[1] is not None]) if any(r[1] is not None for r in read) else ((), ())
                prints: list[bytes] = [b""] * len(ids)
                for numbers in alike(audio):
                    rows = fingerprint(np.stack([audio[k][0] for k in numbers]), audio[numbers[0]][1])
                    for k, row in zip(numbers, rows):
                        prints[k] = row.astype("<u4").tobytes()
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.binary())], ["id", "fingerprint"])

    return media.select(F.col("id").cast("long").alias("id"), F.col("media").cast("binary").alias("media")).where("id is not null and media is not null").mapInArrow(run, "id long, fingerprint binary")


# ---------------------------------------------------------------- alignment


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of unequal bits, steps) where step t of b meets step t + offset of a."""
    start, stop = max(0, -offset), min(len(b), len(a) - offset)
    n = stop - start
    if n <= 0:
        return 1.0, 0
    return float(np.bitwise_count(a[start + offset : stop + offset] ^ b[start:stop]).sum()) / (32 * n), n


def classes(prints: DataFrame) -> DataFrame:
    """(id, class_id, fingerprint) of each id: the smallest id with the same fingerprint; null for an empty one."""
    once = prints.groupBy("id").agg(F.min("fingerprint").alias("fingerprint"))
    first = once.where(F.octet_length("fingerprint") > 0).groupBy(F.sha2("fingerprint", 256).alias("k")).agg(F.min("id").alias("class_id"))
    return once.withColumn("k", F.sha2("fingerprint", 256)).join(first, "k", "left").select("id", "class_id", "fingerprint")


def _blocks(prints: DataFrame) -> tuple[str, int]:
    """(folder, number of blocks): (id, fingerprint) in files of about ``BLOCK`` integers, of like lengths."""
    spark = prints.sparkSession
    sized = prints.withColumn("size", F.ceil(F.log2(F.octet_length("fingerprint") / 4)).cast("int"))
    first, total = [], 0
    for size, n in sorted((r[0], r[1]) for r in sized.groupBy("size").count().collect()):
        blocks = -(-n * 2**size // BLOCK)
        first.append((size, total, blocks))
        total += blocks
    folder = fresh_path(spark, "fingerprint-blocks")
    if total:
        place = F.coalesce(*[F.when(F.col("size") == size, at + F.pmod(F.xxhash64("id"), F.lit(blocks))) for size, at, blocks in first])
        sized.select(place.alias("block"), "id", "fingerprint").repartition(total, "block").write.partitionBy("block").parquet(folder)
    return folder, total


class Block:
    """Some recordings, and the transforms of their bits, which every block they meet uses again."""

    def __init__(self, ids: np.ndarray, prints: list[np.ndarray]):
        self.ids, self.prints, self.held = ids, prints, (0, None)
        self.size = np.fromiter(map(len, prints), np.int64, len(prints))

    def spectra(self, length: int) -> np.ndarray:
        """(frequency, recording, bit): the transforms of the bits as -1 and 1, 0 after the end."""
        if self.held[0] != length:
            signs = np.zeros((len(self.prints), length, 32), np.float32)
            for k, f in enumerate(self.prints):
                signs[k, : len(f)] = ((f[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)).astype(np.float32) * 2 - 1
            self.held = length, np.ascontiguousarray(np.fft.rfft(signs, axis=1).transpose(1, 0, 2))
        return self.held[1]


@lru_cache(4)
def _block(folder: str, block: int) -> Block:
    from pyarrow import dataset, fs

    files, path = filesystem(folder)
    at = f"{path}/block={block}"
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return Block(np.empty(0, np.int64), [])
    rows = dataset.dataset(at, filesystem=files, format="parquet").to_table(columns=["id", "fingerprint"])
    return Block(rows.column("id").to_numpy(), [np.frombuffer(x, "<u4") for x in rows.column("fingerprint").to_pylist()])


def close_offsets(left: Block, right: Block, max_error: float, least_overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number in left, number in right, offset), by tiles: all that may align, and few others."""
    la, lb = left.size, right.size
    # long enough that offsets of ``least_overlap`` common steps meet no other's
    length = -(-int(la.max() + lb.max() - least_overlap) // 16) * 16
    offset = np.arange(length)
    offset = np.where(offset < la.max(), offset, offset - length)[:, None, None]
    side = max(1, math.isqrt(TILE // length))
    mine, theirs = left.spectra(length), right.spectra(length)
    for q in range(0, len(lb), side):
        across = theirs[:, q : q + side].conj().transpose(0, 2, 1)
        for p in range(0, len(la), side):
            same = np.fft.irfft(mine[:, p : p + side] @ across, length, axis=0)  # equal less unequal bits
            a, b = la[None, p : p + side, None], lb[None, None, q : q + side]
            if a.min() == a.max() and b.min() == b.max():
                a, b = a[:, :1], b[:, :, :1]
            n = np.minimum(b, a - offset) - np.maximum(0, -offset)
            least = np.where(n >= least_overlap, 32 * n * (1 - 2 * max_error) - 1 - 1e-5 * length, np.inf).astype(np.float32)
            at, i, j = np.unravel_index(np.flatnonzero(same >= least), same.shape)
            yield p + i, q + j, offset[at, 0, 0]


def votes_near(a: np.ndarray, b: np.ndarray, offset: int) -> int:
    """Equal integers at an offset and those at most ``NEAR_OFFSETS`` from it."""
    out = 0
    for o in range(offset - NEAR_OFFSETS, offset + NEAR_OFFSETS + 1):
        start, stop = max(0, -o), min(len(b), len(a) - o)
        if stop > start:
            out += int((a[start + o : stop + o] == b[start:stop]).sum())
    return out


def alignments(prints: DataFrame, queries: Column | None = None, max_error: float = MAX_ERROR, least_overlap: int = LEAST_OVERLAP) -> DataFrame:
    """(query, id, offset, overlap, votes, error): what each query aligns with, but for itself.

    ``prints`` is (id, fingerprint) without repeats of ids; ``queries`` is a condition on its columns,
    by default all. ``offset`` is where the first step of ``id`` meets the query.
    """
    spark = prints.sparkSession
    least_overlap = max(1, least_overlap)
    long = written(prints.where(F.octet_length("fingerprint") >= 4 * least_overlap), "recordings")
    asked, lefts = _blocks(long if queries is None else long.where(queries))
    folder, rights = _blocks(long)

    def meet(batches):
        for batch in batches:
            for number in batch.column("id").to_pylist():
                left, right = _block(asked, number % lefts), _block(folder, number // lefts)
                if not left.prints or not right.prints:
                    continue
                best = {}
                for hits in close_offsets(left, right, max_error, least_overlap):
                    for i, j, offset in zip(*(h.tolist() for h in hits)):
                        a, b = int(left.ids[i]), int(right.ids[j])
                        if a == b:
                            continue
                        f, g = left.prints[i], right.prints[j]
                        error, n = bit_error(f, g, offset)
                        if error <= max_error and n >= least_overlap:
                            votes = votes_near(f, g, offset)
                            rank = (votes, -error, -abs(offset), offset)
                            if (a, b) not in best or rank > best[a, b][0]:
                                best[a, b] = rank, (a, b, offset, n, votes, error)
                if best:
                    rows = zip(*(row for _, row in best.values()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 5 else pa.int64()) for k, c in enumerate(rows)], ["query", "id", "offset", "overlap", "votes", "error"])

    pairs = lefts * rights
    tasks = max(1, min(pairs, max(8 * spark.sparkContext.defaultParallelism, -(-pairs // 16))))
    return spark.range(0, pairs, 1, tasks).mapInArrow(meet, "query long, id long, offset long, overlap long, votes long, error double")


def tones(embeddings: DataFrame) -> DataFrame:
    """(id, media): a recording of each embedding (vec_id, embedding), a few recordings a batch."""

    def sound(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                media = [None if v is None else wav(render(np.nan_to_num(np.array(v, float)))) for v in part.column("embedding").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(media, pa.binary())], ["id", "media"])

    return embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(sound, "id long, media binary")


def searched(media: DataFrame, queries: Column) -> DataFrame:
    """(id, class_id, fingerprint, other, offset, overlap, votes, error).

    Each recording has its fingerprint and its class. The class that a query is of has a row, under its
    smallest id, for each class that it aligns with (``other``); all others have one without.
    """
    known = written(classes(fingerprints(media)), "fingerprints")
    asked = known.where(queries).select(F.col("class_id").alias("id")).where("id is not null").distinct().withColumn("asked", F.lit(True))
    single = known.where("id = class_id").select("id", "fingerprint").join(asked, "id", "left")
    single = written(single.select("id", "fingerprint", F.coalesce("asked", F.lit(False)).alias("asked")), "recording-classes")
    found = alignments(single, F.col("asked"))
    return known.join(found.select(F.col("query").alias("id"), F.col("id").alias("other"), "offset", "overlap", "votes", "error"), "id", "left")


def query(spark, sf_dir: str) -> DataFrame:
    """All recordings are fingerprinted; those whose id is divisible by ``EVERY`` are the queries against all."""
    return searched(tones(documents(spark, sf_dir, "embeddings")), F.col("id") % EVERY == 0).withColumnRenamed("id", "vec_id")
