"""A source tree as a table: ``spark.read.format("repository").load(root)``.

Built-in file sources leave out names that start with ``.`` or ``_`` (``.env``, ``__init__.py``),
so trees are read by a Python data source. The driver lists the tree once, pruning folders before
it goes into them, and plans partitions of about ``partitionBytes`` bytes; the tasks read the
files. A tree of more than ``LISTED`` files is not held by the driver: it deals out folders, and
parts of those with many entries, and the tasks list them and read. Files that can't be read, and
those with a zero byte at the start, are left out.

Options: ``maxBytes`` (524288), ``partitionBytes`` (16 MiB), ``languages`` (a comma-separated
filter), ``content`` (``false`` reads no more than the start). On a cluster the root must be a folder
that all executors share.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.languages import ALIASES, NAMES, SUFFIXES, language_filter
from ..schemas import FILE

MAX_BYTES = 512 * 1024
SNIFFED = 8192
#: Files that the driver lists; beyond them it deals out folders: so many of those it goes into, so many entries of a part, and so many parts of a folder.
LISTED, FOLDERS, ENTRIES, PARTS = 100_000, 2_000, 4_096, 24
#: Tasks for the folders that aren't in parts; folders that one listing keeps open at once.
TASKS, OPEN = 256, 100
#: Besides hidden folders and those of installed packages.
SKIPPED = frozenset("__pycache__ build dist eggs node_modules venv".split())
BINARY = frozenset("." + x for x in "7z a avi bin bmp bz2 class dll doc docx dylib eot exe flac gif gz ico jar jpeg jpg lib mkv mov mp3 mp4 o obj ogg otf pdf png pyc pyd pyo rar so tar tgz tif tiff ttf war wav webm webp whl woff woff2 xls xlsx xz zip".split())


# ---------------------------------------------------------------- ignore rules


def _rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern over the path below the root, negated, folders only) of a line of an ignore file."""
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line.removeprefix("\\")
    folders, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            inner = line[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out, i = out + re.escape(line[i]), i + 1
    try:
        return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, folders
    except re.error:
        return None


class Ignored:
    """The rules of the root's ignore file; the last rule that matches decides."""

    def __init__(self, lines: list[str]):
        self.rules = [r for r in map(_rule, lines) if r]

    def __call__(self, path: str, folder: bool) -> bool:
        out = False
        for pattern, negated, folders in self.rules:
            if (folder or not folders) and pattern.match(path):
                out = not negated
        return out

    @classmethod
    def of(cls, root: str) -> Ignored:
        try:
            with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
                return cls(f.readlines())
        except OSError:
            return cls([])


# ---------------------------------------------------------------- listing and reading


def language_of(name: str) -> str | None:
    """As ``functions.languages.detect_language``, for a name on the driver."""
    low = name.lower()
    if low == ".env" or low.startswith(".env."):
        return "env"
    bare = low.lstrip(".")
    end = "." + bare.rpartition(".")[2] if "." in bare.strip(".") and not low.endswith(".") else ""
    return NAMES.get(low) or ("env" if end == ".env" else SUFFIXES.get(end))


def wanted(name: str, languages: set[str]) -> bool:
    lang = language_of(name)
    if not languages:
        return lang is not None
    resolved = {ALIASES.get(x, x) for x in languages}
    return lang in resolved | ({"yaml"} if "kubernetes" in resolved else set())


def skipped_folder(name: str) -> bool:
    return name.startswith(".") or name in SKIPPED or name.endswith(".egg-info")


@dataclass
class Place:
    """A folder to list: the entries whose hash leaves ``part`` of ``parts``; with or without the folders below."""

    folder: str = ""
    part: int = 0
    parts: int = 1
    below: bool = True


def _part(name: str, parts: int) -> int:
    return zlib.crc32(os.fsencode(name)) % parts


def _entries(root: str, folder: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(path below the root, name, folder, link) of a folder's entries."""
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            for e in found:
                try:
                    is_folder = e.is_dir()
                except OSError:
                    is_folder = False
                yield f"{folder}/{e.name}" if folder else e.name, e.name, is_folder, is_folder and e.is_symlink()
    except OSError:
        return


def found_files(root: str, place: Place, languages: set[str], max_bytes: int, ignored: Ignored) -> Iterator[tuple[str, int, int]]:
    """(path below the root, size, mtime_ns) of the files to read at a place, in any order."""
    open_ = [(place, _entries(root, place.folder))]
    while open_:
        at, entries = open_[-1]
        for path, name, folder, link in entries:
            if at.parts > 1 and _part(name, at.parts) != at.part:
                continue
            if folder:
                if at.below and not link and not skipped_folder(name) and not ignored(path, True):
                    below = _entries(root, path)
                    open_.append((Place(path), below if len(open_) < OPEN else iter(list(below))))
                    break
            elif wanted(name, languages) and os.path.splitext(name)[1].lower() not in BINARY and not ignored(path, False):
                try:
                    found = os.stat(os.path.join(root, path))
                except OSError:
                    continue
                if found.st_size <= max_bytes:
                    yield path, found.st_size, found.st_mtime_ns
        else:
            open_.pop()


def places(root: str, ignored: Ignored) -> list[Place]:
    """A tree's folders dealt out: each file is at one place, and neither folders nor places grow with the files."""
    out, level = [], [""]
    seen = 0
    while level:
        below: list[str] = []
        for k, folder in enumerate(level):
            if seen + len(below) >= FOLDERS:
                out += [Place(f) for f in level[k:] + below]
                return out
            seen += 1
            entries, folders = 0, []
            for path, name, is_folder, link in _entries(root, folder):
                entries += 1
                if is_folder and not link and len(folders) <= ENTRIES and not skipped_folder(name) and not ignored(path, True):
                    folders.append(path)
            parts = min(PARTS, -(-entries // ENTRIES))
            many = len(folders) > ENTRIES
            out += [Place(folder, i, parts, many) for i in range(parts)]
            below += [] if many else folders
        level = below
    return out


def discover(root: str, languages: set[str] | None = None, max_bytes: int = MAX_BYTES) -> list[tuple[str, int, int]]:
    """(path below the root, size, mtime_ns) of the files to read, in order of path."""
    root = os.path.abspath(root)
    return sorted(found_files(root, Place(), languages or set(), max_bytes, Ignored.of(root)))


@dataclass
class Files(InputPartition):
    root: str
    files: list[tuple[str, int, int]]


@dataclass
class Places(InputPartition):
    root: str
    places: list[Place]


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("load() needs the folder of the tree")
        self.root = os.path.abspath(options["path"].removeprefix("file://"))
        self.languages = language_filter(options.get("languages", ""))
        self.max_bytes = int(options.get("maxbytes", MAX_BYTES))
        self.partition_bytes = int(options.get("partitionbytes", 16 << 20))
        self.with_content = options.get("content", "true").lower() != "false"

    def partitions(self):
        ignored = Ignored.of(self.root)
        files = list(islice(found_files(self.root, Place(), self.languages, self.max_bytes, ignored), LISTED + 1))
        if len(files) > LISTED:
            # Parts of large folders are a task each, others are put together.
            dealt = places(self.root, ignored)
            alone, rest = [p for p in dealt if p.parts > 1], [p for p in dealt if p.parts == 1]
            return [Places(self.root, [p]) for p in alone] + [Places(self.root, rest[i::TASKS]) for i in range(min(TASKS, len(rest)))]
        out, now, size = [], [], 0
        for file in sorted(files):
            if now and size + file[1] > self.partition_bytes:
                out.append(Files(self.root, now))
                now, size = [], 0
            now.append(file)
            size += file[1] + 4096
        return [*out, Files(self.root, now)]

    def read(self, partition: Files | Places):
        if isinstance(partition, Places):
            ignored = Ignored.of(self.root)
            files = (f for p in partition.places for f in found_files(self.root, p, self.languages, self.max_bytes, ignored))
        else:
            files = partition.files
        for path, size, mtime in files:
            try:
                with open(os.path.join(partition.root, path), "rb") as f:
                    data = f.read() if self.with_content else f.read(SNIFFED)
            except OSError:
                continue
            if b"\0" not in data[:SNIFFED]:
                yield path, size, mtime, data.decode("utf-8", "replace") if self.with_content else None


class RepositorySource(DataSource):
    @classmethod
    def name(cls):
        return "repository"

    def schema(self):
        return FILE

    def reader(self, schema):
        return RepositoryReader({k.lower(): v for k, v in self.options.items()})


def read_repository(spark: SparkSession, root: str, languages: str = "", **options) -> DataFrame:
    """(path, size, mtime_ns, content) of a source tree."""
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repository").options(languages=languages, **options).load(root)


def write_tree(files: DataFrame, folder: str) -> None:
    """Write (path, content) below a folder that all executors share, each file by the task that has its row.

    ``content`` is text or bytes; rows of equal path, of which any may be the last, are for the caller to avoid.
    """

    def write(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                at = os.path.join(folder, path)
                try:
                    f = open(at, "wb")
                except FileNotFoundError:
                    os.makedirs(os.path.dirname(at), exist_ok=True)
                    f = open(at, "wb")
                with f:
                    f.write(content.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([0])], ["n"])

    files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def shared_folder(spark: SparkSession) -> str:
    """A new folder for a tree, in the one that ``spark.checkpoint.dir`` names; a temporary one in local mode without it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at and re.match(r"file:|/", at):
        out = os.path.join(re.sub(r"^file:(//)?", "", at), f"tree-{uuid.uuid4().hex}")
        os.makedirs(out)
        return out
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a mounted folder that all executors share")
    return tempfile.mkdtemp(prefix="sluice-tree-")
