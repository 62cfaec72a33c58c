"""Operator 8, line dedup: a join within an edit bound, by deletion neighbourhoods or pieces.

A line is dropped if an earlier line of the corpus, in order of (doc_id, line number), is
within ``max_edits`` edits (a character inserted, deleted or replaced; 1 by default) of it; the
earliest such line is named. Lines are compared trimmed and in lower case; those of fewer than ``min_chars``
characters take no part, as short lines are alike by chance.

1. Equal lines become one class by hash; its first line stands for it.
2. Two lines within one edit share their first or their last half: the half of the shorter
   one. Classes that share neither with any class of a fitting length can have no partner.
   This exact sieve, made of hashes only, leaves few classes.
3. For those, all variants with one character deleted, and the line itself, are emitted as
   hashed keys (a rolling hash gives the n variants of n characters in one pass); equal
   keys make candidate pairs, and each pair's edit distance is verified on the text.

With a bound of 2 or more, 2 and 3 give way to pieces: the shorter line of a pair is cut into
``max_edits`` + 1, one of which the other has unchanged, moved by as much as the bound and the
lengths allow; such places make the candidate pairs. The result is exact for any bound.

Cases: null text or id takes no part; an empty text has no line long enough; lines of any
length are taken whole; rows with the same ``doc_id`` are one document: the same line number
with the same content in it is one line and never drops itself; ties can't occur, as (doc_id,
line number) orders all lines. In :func:`without_repeated_lines` rows that take no part stay
as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, TOP, U64, char_values, code_points, documents, each_partition, fresh, maybe_broadcast, mix, packed_exchange, powers, prefix_hashes, run_pairs, runs, slices, texts_of, written

MIN_CHARS = 24
MAX_EDITS = 1
BLANKS = " \t\r\x0b\x0c"


def normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(BLANKS)))


def lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, line): normalised lines that are long enough."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    split = read.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return split.select("doc_id", "line_no", normal(F.col("raw")).alias("line")).where(F.length("line") >= min_chars)


def _keys(lined: DataFrame) -> DataFrame:
    """The hashes of each line: of all of it, and of its halves as the shorter and the longer of a pair."""
    n = F.length("line")
    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    head = lambda m: F.xxhash64(F.substring("line", F.lit(1), m))
    tail = lambda m: F.xxhash64(F.substring("line", -m, m))
    return lined.select("doc_id", "line_no", F.xxhash64("line").alias("h"), n.alias("n"), head(half).alias("head"), tail(half).alias("tail"), head(less).alias("head_less"), tail(less).alias("tail_less"))


def deletion_variants(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed variant): the text and each text with one character less, distinct."""
    codes = code_points("".join(texts))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    start = end - size
    sums = prefix_hashes(char_values()[np.minimum(codes, TOP - 1)])
    _, down = powers(len(codes) + 1)
    whole = mix((sums[end] - sums[start]) * down[start])
    doc = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(codes))
    a, b = start[doc], end[doc]
    less = mix(((sums[at] - sums[a]) + (sums[b] - sums[at + 1]) * down[1]) * down[a])
    new = np.concatenate([[True], (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])]) if len(codes) else np.empty(0, bool)
    return np.concatenate([np.arange(len(texts)), doc[new]]), np.concatenate([whole, less[new]])


def pieces(texts: list[str], max_edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(text numbers, hashed pieces, whether they are a text's own): own pieces of the shorter text of a
    pair meet the places of the longer one where they can be if at most ``max_edits`` edits lie between."""
    codes = code_points("".join(texts))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size) - size
    sums = prefix_hashes(char_values()[np.minimum(codes, TOP - 1)])
    _, down = powers(len(codes) + 1)
    for more in range(max_edits + 1):
        short = size - more
        for piece in range(max_edits + 1):
            longer = short % (max_edits + 1)
            length = short // (max_edits + 1) + (piece >= max_edits + 1 - longer)
            first = piece * (short // (max_edits + 1)) + np.maximum(0, piece - (max_edits + 1 - longer))
            for move in range(-((max_edits - more) // 2), (max_edits + more) // 2 + 1):
                at = first + move
                fits = np.flatnonzero((short > 0) & (at >= 0) & (at + length <= size))
                a, n = start[fits] + at[fits], length[fits]
                key = mix(mix((sums[a + n] - sums[a]) * down[a]) + (short[fits] * (max_edits + 1) + piece).astype(U64))
                if more == move == 0:
                    yield fits, key, True
                yield fits, key, False


def near_by_pieces(lined: DataFrame, max_edits: int) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs (a, b), texts (h, line)) for any bound."""
    texts = written(lined.select(F.xxhash64("line").alias("h"), "line").dropDuplicates(["h"]), "line-texts")

    def emit(batch):
        for part in slices(batch, "line", 200_000):
            ids = part.column("h").to_numpy()
            for text, key, own in pieces(texts_of(part, "line"), max_edits):
                yield np.stack([key.view(np.int64), np.full(len(key), not own, np.int64), ids[text]], axis=1)

    def meet(rows):
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        start, end = runs(rows[:, 0])
        own = np.add.reduceat(1 - rows[:, 1], start)
        for a, b, m in zip(*(x[(own > 0) & (end - start > 2)].tolist() for x in (start, end, own))):
            step = max(1, (1 << 20) // (b - a - m))
            for i in range(a, a + m, step):
                x, y = rows[i : min(i + step, a + m), 2], rows[a + m : b, 2]
                x, y = np.repeat(x, len(y)), np.tile(y, len(x))
                x, y = x[x != y], y[x != y]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return each_partition(packed_exchange(texts, emit, 3, growth=8), meet, 3, "a long, b long").distinct(), texts


def near_by_halves(classes: DataFrame, lined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs (a, b), texts (h, line)) for a bound of 1."""
    role = lambda m, half, tag, own: F.struct(F.xxhash64(m, half, F.lit(tag)).alias("k"), F.lit(own).alias("own"))
    n, m = F.col("n"), F.col("n") - 1
    keyed = classes.select("h", "doc_id", "line_no", F.explode(F.array(role(n, F.col("head"), 0, True), role(n, F.col("tail"), 1, True), role(m, F.col("head_less"), 0, False), role(m, F.col("tail_less"), 1, False))).alias("r"))
    keyed = keyed.select("h", "doc_id", "line_no", "r.k", "r.own")
    # Counted before they are joined, so that a key of very many lines is one row in every task.
    shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("own")).where("c > 1 and own").select("k")
    left = written(keyed.drop("own").join(shared, "k", "left_semi").select("h", "doc_id", "line_no").distinct(), "line-survivors")
    few = maybe_broadcast(left, left.count(), 64)
    texts = written(lined.join(few, ["doc_id", "line_no"]).select("h", "line").dropDuplicates(["h"]), "line-texts")

    def emit(batch):
        for part in slices(batch, "line", 200_000):
            ids = part.column("h").to_numpy()
            doc, variant = deletion_variants(texts_of(part, "line"))
            yield np.stack([variant.view(np.int64), ids[doc]], axis=1)

    def equal(rows):
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]
        start, end = runs(rows[:, 0])
        many = end - start > 1
        for i, j in run_pairs(start[many], end[many]):
            pair = np.unique(np.stack([rows[i, 1], rows[j, 1]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    return each_partition(packed_exchange(texts, emit, 2, growth=16), equal, 2, "a long, b long").distinct(), texts


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two arrays of code points if it is at most ``most``, else -1.

    Per number of edits and diagonal the furthest place that is reached, so that the work is the
    length and ``most`` squared (with the built-in function two lines of a million characters took minutes).
    """

    def slide(i: int, j: int) -> int:
        step = 64
        while i < len(a) and j < len(b):
            n = min(step, len(a) - i, len(b) - j)
            unlike = a[i : i + n] != b[j : j + n]
            first = int(unlike.argmax())
            if unlike[first]:
                return i + first
            i, j, step = i + n, j + n, step * 4
        return i

    goal = len(b) - len(a)
    if abs(goal) > most:
        return -1
    reach = {0: slide(0, 0)}
    for edits in range(most + 1):
        if reach.get(goal, -1) >= len(a):
            return edits
        further = {}
        for d in range(-edits - 1, edits + 2):
            i = min(max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1), len(a), len(b) - d)
            if i >= 0 and i + d >= 0:
                further[d] = slide(i, i + d)
        reach = further
    return -1


def _verified(most: int):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(c) for c in ("a", "b", "x", "y"))
            edits = np.fromiter((edits_within(code_points(t), code_points(u), most) for t, u in zip(x.to_pylist(), y.to_pylist())), np.int32, batch.num_rows)
            close = pa.array(edits >= 0)
            yield pa.RecordBatch.from_arrays([a.filter(close), b.filter(close), pa.array(edits).filter(close)], ["a", "b", "edits"])

    return run


def near_classes(classes: DataFrame, lined: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(h, other, edits): classes within the bound of each other, in both directions."""
    pairs, texts = near_by_halves(classes, lined) if max_edits == 1 else near_by_pieces(lined, max_edits)
    left_text, right_text = texts.select(F.col("h").alias("a"), F.col("line").alias("x")), texts.select(F.col("h").alias("b"), F.col("line").alias("y"))
    close = pairs.join(left_text, "a").join(right_text, "b").select("a", "b", "x", "y").mapInArrow(_verified(max_edits), "a long, b long, edits int")
    return close.select("edits", F.explode(F.array(F.struct(F.col("a").alias("h"), F.col("b").alias("other")), F.struct(F.col("b").alias("h"), F.col("a").alias("other")))).alias("p")).select("p.*", "edits")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, with_hash: bool = False, max_edits: int = MAX_EDITS) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no, distance): the lines to drop and what they repeat."""
    lined = lines(docs, min_chars)
    keyed = _keys(lined)
    place = F.struct("doc_id", "line_no")
    halves = ("n", "head", "tail", "head_less", "tail_less")
    classes = written(keyed.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), *[F.min(c).alias(c) for c in halves]).select("h", "first.*", (F.col("first") != F.col("last")).alias("many"), *halves), "line-classes")
    firsts = classes.select(F.col("h").alias("other"), F.struct("doc_id", "line_no").alias("at"))
    earlier = near_classes(classes, lined, max_edits).join(firsts, "other").groupBy("h").agg(F.min(F.struct("at", "edits")).alias("m")).select("h", F.col("m.at").alias("near"), "m.edits")
    # F.least of structs compares field by field, as the order of lines does.
    kept = classes.select("h", "many", F.struct("doc_id", "line_no").alias("first")).join(earlier, "h", "left")
    kept = kept.where("many or near < first").select("h", F.least("first", F.coalesce("near", "first")).alias("kept"), F.when(F.col("near") < F.col("first"), F.col("edits")).otherwise(0).alias("distance"))
    out = keyed.select("doc_id", "line_no", "h").join(kept, "h").where(F.struct("doc_id", "line_no") != F.col("kept"))
    return out.select("doc_id", "line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"), "distance", *(["h"] if with_hash else [])).distinct()


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = MAX_EDITS) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_chars`` to match.

    Documents of which only blanks are left are dropped; those that lose no line stay as they are.
    """
    id_, lost = fresh(docs, "__id"), fresh(docs, "__gone")
    each = repeated_lines(docs, min_chars, with_hash=True, max_edits=max_edits).groupBy(F.col("doc_id").alias(id_), "line_no").agg(F.collect_set("h").alias("hs"))
    # By line number, so that a line is looked up in one step: null where no line goes.
    placed = F.sort_array(F.collect_list(F.struct("line_no", "hs")))
    gaps = F.zip_with("at", F.concat(F.array(F.lit(-1)), F.slice("at.line_no", 1, F.size("at") - 1)), lambda x, before: F.struct((x["line_no"] - before - 1).alias("n"), x["hs"].alias("hs")))
    none = F.lit(None).cast("array<long>")
    gone = each.groupBy(id_).agg(placed.alias("at")).select(id_, F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(none, g["n"]), F.array(g["hs"])))).alias(lost))
    kept = F.filter(F.split(F.col("text").cast("string"), "\n"), lambda line, i: ~F.coalesce(F.array_contains(F.get(F.col(lost), i), F.xxhash64(normal(line))), F.lit(False)))
    joined = docs.join(gone, F.col("doc_id").cast("long") == F.col(id_), "left")
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn("text", text).where(F.col(lost).isNull() | (F.length(F.btrim("text", F.lit(BLANKS + "\n"))) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_lines(documents(spark, sf_dir))


DROPS_CTES = """
l0 as (select doc_id, unnest(range(len(s))) as line_no, unnest(s) as raw
       from (select doc_id, string_split(text, chr(10)) as s from {documents} where text is not null and doc_id is not null)),
l as (select doc_id, line_no, lower(trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) as line from l0),
li as (select distinct * from l where length(line) >= {min_chars}),
c as (select line, length(line) as n, min([doc_id, line_no]) as first from li group by line),
p as (select a.line as a, b.line as b from c a join c b on b.n in (a.n, a.n + 1) and left(a.line, a.n // 2) = left(b.line, a.n // 2)
      where a.line <> b.line and levenshtein(a.line, b.line) <= 1
      union select a.line, b.line from c a join c b on b.n in (a.n, a.n + 1) and right(a.line, a.n // 2) = right(b.line, a.n // 2)
      where a.line <> b.line and levenshtein(a.line, b.line) <= 1),
pp as (select a as line, b as other from p union select b, a from p),
e as (select pp.line, min(c.first) as near from pp join c on c.line = pp.other group by pp.line),
k as (select c.line, case when e.near < c.first then e.near else c.first end as kept, case when e.near < c.first then 1 else 0 end as distance
      from c left join e on c.line = e.line),
drops as (select li.doc_id, li.line_no, k.kept[1] as kept_doc_id, k.kept[2] as kept_line_no, k.distance from li join k on li.line = k.line
          where [li.doc_id, li.line_no] <> k.kept)
"""


def drops_ctes(table: str = "documents", min_chars: int = MIN_CHARS) -> str:
    return DROPS_CTES.replace("{documents}", table).replace("{min_chars}", str(min_chars))


ORACLE = "with " + drops_ctes() + "select doc_id, line_no::int as line_no, kept_doc_id, kept_line_no::int as kept_line_no, distance::int as distance from drops"
