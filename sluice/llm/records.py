"""Operator 9, token-ID / binary output: length-delimited binary records with an offset index.

Each document becomes one record: its token ids as little-endian unsigned integers of 16 bits
(32 where the vocabulary is larger), framed as

    length (8 bytes) | masked CRC-32C of the length (4) | data | masked CRC-32C of the data (4)

which is the public TFRecord framing; a checksum c is masked as ``rotate_right(c, 15) +
0xa282ead8``. Each task writes one file of records in the folder given, under a name of its
own for each attempt, and returns the place of each record. These rows are the offset index, a
Parquet table: it names only the files of attempts that Spark committed, so a lost executor or
a second attempt leaves at most files that nothing refers to. For shuffled reads, rows of the
index in any order give file, offset and size of each record.

Cases: null text or id has no record; an empty text has a record of no ids; rows with the same
``doc_id`` have a record each; texts of any length are encoded whole; an empty table gives an
empty index. Other columns are not looked at.
"""

from __future__ import annotations

import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DEFAULT_RANKS, documents, encode, filesystem, fresh_path, slices, texts_of, tokenizer

INDEX = "doc_id long, file string, offset long, bytes long, n_tokens long, checksum long"
_BLOCK = 256


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Eight tables for eight bytes at once, and four that move a checksum past a block of zeros."""
    t = np.zeros((8, 256), np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        t[0, i] = c
    for k in range(1, 8):
        t[k] = t[0, t[k - 1] & 255] ^ (t[k - 1] >> 8)

    def move(c):
        for _ in range(_BLOCK):
            c = t[0, c & 255] ^ (c >> 8)
        return c

    return t, np.stack([move(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])


def _few(data: bytes) -> int:
    t, c = _tables()[0][0], 0xFFFFFFFF
    for b in data:
        c = int(t[(c ^ b) & 255]) ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def crc32c(records: list[bytes]) -> np.ndarray:
    """CRC-32C of many byte strings at once.

    With its first four bytes inverted a string's checksum starts from 0, and zeros in front of
    it change nothing: all strings become whole blocks, whose checksums are computed in step
    and then joined along each string.
    """
    t, skip = _tables()
    size = np.fromiter(map(len, records), np.int64, len(records))
    out = np.zeros(len(records), np.uint32)
    for i in np.flatnonzero(size < 4):
        out[i] = _few(records[i])
    long = np.flatnonzero(size >= 4)
    long = long[np.argsort(-size[long], kind="stable")]
    if not len(long):
        return out
    blocks = -(-size[long] // _BLOCK)
    ends = np.cumsum(blocks) * _BLOCK
    flat = np.zeros(ends[-1], np.uint8)
    for i, end in zip(long, ends):
        flat[end - size[i] : end] = np.frombuffer(records[i], np.uint8)
    heads = ends - size[long]
    for k in range(4):
        flat[heads + k] ^= 255
    words = flat.view("<u8").reshape(-1, _BLOCK // 8)
    c = np.zeros(len(words), np.uint32)
    for j in range(_BLOCK // 8):
        x = words[:, j] ^ c
        c = t[7][x & np.uint64(255)]
        for k in range(1, 8):
            c = c ^ t[7 - k][(x >> np.uint64(8 * k)) & np.uint64(255)]
    first = np.cumsum(blocks) - blocks
    total = np.zeros(len(long), np.uint32)
    for j in range(blocks[0]):
        n = int(np.searchsorted(-blocks, -j, side="left"))
        x = total[:n]
        total[:n] = skip[0][x & 255] ^ skip[1][(x >> 8) & 255] ^ skip[2][(x >> 16) & 255] ^ skip[3][x >> 24] ^ c[first[:n] + j]
    out[long] = ~total
    return out


def masked(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return ((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(0xA282EAD8)


def framed(records: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(framed records, masked checksums of their data)."""
    lengths = [struct.pack("<Q", len(r)) for r in records]
    of_length, of_data = masked(crc32c(lengths)), masked(crc32c(records))
    return [n + struct.pack("<I", a) + r + struct.pack("<I", b) for n, a, r, b in zip(lengths, of_length.tolist(), records, of_data.tolist())], of_data


def _width(ranks: str):
    return np.dtype("<u2") if tokenizer(ranks).n_vocab <= 1 << 16 else np.dtype("<u4")


def write_records(docs: DataFrame, folder: str, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """Write the records and their index under ``folder``, and return the index."""

    def write(batches):
        out, offset = None, 0
        name = f"records-{uuid.uuid4().hex}.bin"
        try:
            for batch in batches:
                for part in slices(batch):
                    if out is None:
                        files, path = filesystem(folder)
                        files.create_dir(f"{path}/data", recursive=True)
                        out, width = files.open_output_stream(f"{path}/data/{name}"), _width(ranks)
                    ids = [encode(tokenizer(ranks), t).astype(width) for t in texts_of(part)]
                    frames, checks = framed([x.tobytes() for x in ids])
                    out.write(b"".join(frames))
                    size = np.fromiter(map(len, frames), np.int64, len(frames))
                    at = offset + np.cumsum(size) - size
                    offset += int(size.sum())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([name] * len(frames)), pa.array(at), pa.array(size), pa.array(np.fromiter(map(len, ids), np.int64, len(ids))), pa.array(checks.astype(np.int64))], ["doc_id", "file", "offset", "bytes", "n_tokens", "checksum"])
        finally:
            if out is not None:
                out.close()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    read.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, ids) of the index's rows, in whatever order and selection they come; checksums are verified."""

    def read(batches):
        files, path = filesystem(folder)
        width = _width(ranks)
        for batch in batches:
            opened, datas = {}, []
            for file, offset, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "bytes"))):
                if file not in opened:
                    opened[file] = files.open_input_file(f"{path}/data/{file}")
                frame = opened[file].read_at(size, offset)
                (n,) = struct.unpack("<Q", frame[:8])
                if n != size - 16 or struct.unpack("<I", frame[8:12])[0] != masked(crc32c([frame[:8]]))[0]:
                    raise ValueError(f"length of the record at {file}:{offset} is damaged")
                datas.append((frame[12:-4], struct.unpack("<I", frame[-4:])[0], f"{file}:{offset}"))
            for (_, want, place), is_ in zip(datas, masked(crc32c([d for d, _, _ in datas]))):
                if want != is_:
                    raise ValueError(f"data of the record at {place} is damaged")
            for f in opened.values():
                f.close()
            ids = [np.frombuffer(d, width).astype(np.int32).tolist() for d, _, _ in datas]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return index.mapInArrow(read, "doc_id long, ids array<int>")


def query(spark, sf_dir: str) -> DataFrame:
    return write_records(documents(spark, sf_dir), fresh_path(spark, "token-records"))
