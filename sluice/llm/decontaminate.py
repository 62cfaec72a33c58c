"""Operator 1, benchmark decontamination: one Aho-Corasick automaton over test items.

Each benchmark text is normalised to words (runs of letters, marks and digits, in lower case;
a letter whose lower case is longer than one character stays as it is). Its patterns are all
windows of ``n`` words, or the whole item where it has fewer. The automaton's alphabet are
words: each word of the items is a sign of its own, every other word is one more, so that a text
is scanned once, a sign a word, and a match is reported by its place in the original text, which
the word numbers give. (64-bit hashes stand for words.)

Items of fewer than ``min_words`` words, short answers, are found where they are a whole line:
within running text they would be found by chance everywhere.

The items stay in a table in the shared folder, from which each Python worker builds its automaton:
about 100 bytes for each byte of items. Items of more than ``ITEM_BYTES`` are split in parts of that
size by hash of their id, and each part has an automaton and a scan of its own, one after the other.
So neither the driver nor a worker holds more than a part, and every item is looked for.

Cases: a null text or null id has no matches; an empty benchmark gives an empty result; equal items
are each reported, and so are the texts of a repeated ``item_id``, as one item; rows with the same
``doc_id`` are scanned each on its own and reported under that id; texts of any length are scanned
whole; an empty text has no words and no match. Other columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, by_text, code_points, filesystem, fresh_path, slices, texts_of, written

N_WORDS = 8
MIN_WORDS = 5
#: Bytes of item texts for one automaton.
ITEM_BYTES = 1 << 20

SPANS = "doc_id long, item_id long, start long, end long, hits long"
#: Signs: a word that no item has, the end of a text, and the first word of the items.
OTHER, BREAK, FIRST = 1, 2, 0x100


def _signs(n: int) -> np.ndarray:
    """Code points for n words, none of them a surrogate."""
    out = np.arange(FIRST, FIRST + n, dtype=np.uint32)
    return np.where(out >= 0xD800, out + 0x800, out).astype(np.uint32)


class Automaton:
    """The automaton of some items (id, text)."""

    def __init__(self, items: list[tuple[int, str]], n: int = N_WORDS, min_words: int = MIN_WORDS):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        w = Words([text for _, text in items])
        self.words = np.unique(w.hash)
        self.signs = _signs(len(self.words))
        text = self._text(w.hash)
        for (item, _), a, b in zip(items, w.first.tolist(), w.first[1:].tolist()):
            for i in range(a, max(a, b - n) + 1) if b > a else ():
                pattern = text[i : min(i + n, b)]
                known = self.machine.get(pattern, None)
                if known is None:
                    self.machine.add_word(pattern, (len(pattern), len(pattern) < min_words, {item}))
                else:
                    known[2].add(item)
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()

    def _text(self, hashes: np.ndarray) -> str:
        if not len(self.words):
            return ""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.signs[at], np.uint32(OTHER)).astype("<u4").tobytes().decode("utf-32-le")

    def hits(self, texts: list[str]):
        """(text number, item, first word, words, start, end) of every match, offsets in the text."""
        if self.empty:
            return
        w = Words(texts)
        if not len(w.start):
            return
        at = np.arange(len(w.doc)) + w.doc
        out = np.full(at[-1] + 1, BREAK, np.uint32)
        word_at = np.zeros(len(out), np.int64)
        out[at] = np.frombuffer(self._text(w.hash).encode("utf-32-le"), np.uint32)
        word_at[at] = np.arange(len(at))
        lines = None
        for end, (words, short, items) in self.machine.iter(out.astype("<u4").tobytes().decode("utf-32-le")):
            last = int(word_at[end])
            first = last - words + 1
            if short:
                if lines is None:
                    lines = np.cumsum(code_points("\n".join(texts)) == 0x0A)[w.start]
                if lines[first] != lines[last] or (first and lines[first - 1] == lines[first]) or (last + 1 < len(lines) and lines[last + 1] == lines[last]):
                    continue
            doc = int(w.doc[last])
            for item in items:
                yield doc, item, first - int(w.first[doc]), words, int(w.start[first] - w.base[doc]), int(w.end[last] - w.base[doc])

    def spans(self, texts: list[str]):
        """(text number, item, start, end, hits): matches of an item that overlap or touch are one."""
        found = sorted((d, i, word, n, a, b) for d, i, word, n, a, b in self.hits(texts))
        now = None
        for d, i, word, n, a, b in found:
            if now and now[0] == d and now[1] == i and word <= now[5]:
                now[3], now[4], now[5] = max(now[3], b), now[4] + 1, max(now[5], word + n)
            else:
                if now:
                    yield now[:5]
                now = [d, i, a, b, 1, word + n]
        if now:
            yield now[:5]


def _stored(benchmark: DataFrame) -> tuple[str, int]:
    """(folder, parts) of the items, in files by part."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-size // ITEM_BYTES))
    folder = fresh_path(benchmark.sparkSession, "benchmark-items")
    items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(count))).repartition("part").write.partitionBy("part").parquet(folder)
    return folder, count


@lru_cache(1)
def _automaton(folder: str, part: int, n: int, min_words: int) -> Automaton:
    from pyarrow import dataset, fs

    files, path = filesystem(folder)
    at = f"{path}/part={part}"
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return Automaton([], n, min_words)
    rows = dataset.dataset(at, filesystem=files, format="parquet").to_table(columns=["item_id", "text"])
    return Automaton(list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist())), n, min_words)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, start, end, hits): where benchmark items occur in documents.

    A map over the documents for each part: no shuffle, columns pruned to the two it reads.
    """
    folder, count = _stored(benchmark)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")

    def scan(k):
        def run(batches):
            for batch in batches:
                for part in slices(batch):
                    ids = part.column("doc_id").to_pylist()
                    rows = [(ids[d], *rest) for d, *rest in _automaton(folder, k, n, min_words).spans(texts_of(part))]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "start", "end", "hits"])

        return read.mapInArrow(run, SPANS)

    out = scan(0)
    for k in range(1, count):
        out = out.unionByName(scan(k))
    return out


def is_contaminated(folder: str, k: int, n: int = N_WORDS, min_words: int = MIN_WORDS) -> Column:
    """A boolean column over ``text`` for the items of part ``k``; a null text is false."""

    def found(texts: pa.Array) -> pa.Array:
        def any_hit(values):
            out = np.zeros(len(values), bool)
            for d, *_ in _automaton(folder, k, n, min_words).hits(values):
                out[d] = True
            return out

        return pa.array(by_text(any_hit, texts, bool))

    return F.arrow_udf(found, "boolean")(F.col("text").cast("string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without those that hold a passage of a benchmark item; all columns kept.

    Rows with a null text stay: nothing in them can leak. Where the items have several parts, each
    scans what the one before has left.
    """
    folder, count = _stored(benchmark)
    out = docs.where(~is_contaminated(folder, 0, n, min_words))
    for k in range(1, count):
        out = written(out, "decontaminated").where(~is_contaminated(folder, k, n, min_words))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return contaminated_spans(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


_SPLIT = """
  select {id} as id, unnest(generate_series(1, len(w))) as k, unnest(w) as word,
         unnest(list_transform(generate_series(1, len(w)), lambda i: length(g[i]))) as gap,
         unnest(list_transform(generate_series(1, len(w)), lambda i: length(g[i]) - length(replace(g[i], chr(10), '')))) as breaks
  from (select {id}, regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}]+') as w,
               regexp_split_to_array(text, '[\\p{L}\\p{N}\\p{M}]+') as g
        from {table} where text is not null and {id} is not null)"""

SPANS_CTES = (
    "dw as (" + _SPLIT.replace("{id}", "doc_id").replace("{table}", "{documents}") + "), bw as (" + _SPLIT.replace("{id}", "item_id").replace("{table}", "benchmark") + """),
dp as (select id, k, lower(word) as word, sum(gap + length(word)) over up - length(word) as a, sum(gap + length(word)) over up as b, sum(breaks) over up as line
       from dw window up as (partition by id order by k)),
bc as (select id, count(*) as m from bw group by id),
bp as (select w.id, w.k, least(c.m, {n}) as n,
              string_agg(lower(word), ' ') over (partition by w.id order by w.k rows between current row and {last} following) as pat, c.m
       from bw w join bc c on w.id = c.id),
pats as (select distinct id as item_id, n, pat, n < {min_words} as short from bp where k <= m - n + 1),
sizes as (select distinct n from pats),
dg as (select d.id, d.k, d.a, s.n, d.line, lead(d.b, (s.n - 1)::int) over up as b, lead(d.k, (s.n - 1)::int) over up as last_k,
              lead(d.line, (s.n - 1)::int) over up as last_line, lag(d.line) over up as line_before, lead(d.line, s.n::int) over up as line_after,
              list(d.word) over (partition by d.id, s.n order by d.k rows between current row and {last} following) as ws
       from dp d cross join sizes s window up as (partition by d.id, s.n order by d.k)),
hit as (select g.id as doc_id, p.item_id, g.k, g.n, g.a, g.b from dg g join pats p
        on p.n = g.n and p.pat = array_to_string(g.ws[1:g.n], ' ') where g.last_k is not null
        and (not p.short or (g.line = g.last_line and g.line is distinct from g.line_before and g.line is distinct from g.line_after))),
flag as (select *, case when k <= max(k + n) over (partition by doc_id, item_id order by k, n rows between unbounded preceding and 1 preceding)
         then 0 else 1 end as new from hit),
isle as (select *, sum(new) over (partition by doc_id, item_id order by k, n rows unbounded preceding) as grp from flag),
spans as (select doc_id, item_id, min(a) as "start", max(b) as "end", count(*) as hits from isle group by doc_id, item_id, grp)
"""
)


def spans_ctes(table: str = "documents", n: int = N_WORDS, min_words: int = MIN_WORDS) -> str:
    """The CTEs up to ``spans`` over a table or CTE with doc_id and text."""
    out = SPANS_CTES
    for name, value in (("documents", table), ("n", n), ("last", n - 1), ("min_words", min_words)):
        out = out.replace("{%s}" % name, str(value))
    return out


ORACLE = "with " + spans_ctes() + 'select doc_id::bigint as doc_id, item_id, "start"::bigint as "start", "end"::bigint as "end", hits from spans'
