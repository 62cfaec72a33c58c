"""Operator 2, quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is made of character n-grams of order ``ORDER`` for each language: their number is
bounded by the language, not by the corpus, and they see broken words, stray signs and odd
case where a word model sees only unknown words. It is trained on the whole texts of all
documents labelled quality = 1, but for those held out to set the thresholds; no n-gram is
sampled or pruned, and every code point of trusted text is told from every other. Where there
are more than ``ALPHABET`` of them, over all languages, the rarest are written as two signs each:
``ORDER`` signs then span fewer of these letters, and a perplexity is that of a sign.

Counts are summed per (language, n-gram); each lower order counts the distinct n-grams that
extend it to the left. Discounts come from the counts of counts of each language and order.
An order's probabilities join, sharded by hash of (language, n-gram), its counts with the
totals of their contexts and with the probabilities of the order below::

    p(w | h) = max(c(hw) - D(c), 0) / c(h) + g(h) * p(w | h')

Documents are scored against the model from arrays that each worker reads from the shared
folder, after a check of their size, or beyond it by joining the distinct n-grams of each chunk of documents with
the shards of each order; both give the same perplexities. A document is kept if its perplexity is at
most the ``quantile`` of trusted documents of its language that the model wasn't trained on
(one in ``HELD_OUT`` by hash of the id; where a language has none, of those it was trained on).
Quantiles are taken on a grid of 0.001 in the logarithm, so they are exact, mergeable and the
same on any cluster.

Cases: null text or id is not scored; an empty text has the perplexity of its end sign; a null
language is the language ''; a document in a language without trusted text isn't kept; rows
with the same ``doc_id`` are scored each; several labels of a document: it is trusted if one
says so; an empty label table keeps nothing. Other columns are not looked at.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, documents, filesystem, fresh_path, maybe_broadcast, plan_bytes, remove, slices, texts_of, written

ORDER = 5
BITS = 12
#: Ids: 0 before a text, 1 after it, 2 any sign that trusted text doesn't have, then the alphabet.
START, END, OTHER, FIRST = 0, 1, 2, 3
ALPHABET = (1 << BITS) - FIRST
QUANTILE = 0.99
HELD_OUT = 5
GRID = 1000
#: The model is held by each executor up to so many n-grams; beyond it, scoring joins shards.
HELD_NGRAMS = 8_000_000
#: Where scoring joins shards: bytes of documents, as the optimizer estimates them, of a chunk, and of a shard that is broadcast.
CHUNK_BYTES = 4 << 20
SHARD_BROADCAST = 4 << 20


def alphabet(trusted: DataFrame) -> list[int]:
    """All code points of trusted text, the most frequent first, ties by code point."""

    def count(batches):
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount(code_points("".join(texts_of(part))), minlength=0x110000)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["c", "n"])

    rows = trusted.select("text").mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").select("c").collect()
    return [r[0] for r in rows]


def signs(letters: list[int]) -> tuple[int, int]:
    """(letters that have an id of their own, ids of each half of the others): a letter beyond the ids is two signs."""
    if len(letters) <= ALPHABET:
        return len(letters), 0
    half = next(t for t in range(1, ALPHABET // 2 + 1) if t * t >= len(letters) - (ALPHABET - 2 * t))
    return ALPHABET - 2 * half, half


def unseen_p(letters: list[int]) -> float:
    own, half = signs(letters)
    return 1.0 / (own + 2 * half + 2)


def ids_table(letters: list[int]) -> np.ndarray:
    """Code point -> its id, and above ``BITS`` bits the id that follows it if it is two signs."""
    table = np.full(0x110000, OTHER, np.int64)
    own, half = signs(letters)
    table[np.array(letters[:own], np.int64)] = np.arange(FIRST, FIRST + own)
    if half:
        rest = np.arange(len(letters) - own)
        table[np.array(letters[own:], np.int64)] = FIRST + own + rest // half | (FIRST + own + half + rest % half) << BITS
    return table


def n_grams(texts: list[str], table: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram ending at each sign, its text), the sign after each text included."""
    codes = table[code_points("".join(texts))]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    two = codes >> BITS > 0
    if two.any():
        size = np.bincount(np.repeat(np.arange(len(texts)), size), 1 + two, len(texts)).astype(np.int64)
        second = np.cumsum(1 + two)[two] - 1
        after = codes[two] >> BITS
        codes = np.repeat(codes & ((1 << BITS) - 1), 1 + two)
        codes[second] = after
    step = size + order
    ends = np.cumsum(step)
    line = np.full(ends[-1] if len(ends) else 0, START, np.int64)
    doc = np.repeat(np.arange(len(texts)), step)
    place = np.arange(len(line)) - np.repeat(ends - step, step)
    line[(place >= order - 1) & (place < step[doc] - 1)] = codes
    line[ends - 1] = END
    grams = line.copy()
    for k in range(1, order):
        grams[k:] |= line[:-k] << (BITS * k)
    real = place >= order - 1
    return grams[real], doc[real]


def counts(trusted: DataFrame, letters: list[int], order: int = ORDER) -> DataFrame:
    """(lang, gram, c): how often each n-gram of the highest order occurs in trusted text."""
    shared = trusted.sparkSession.sparkContext.broadcast(letters)

    def count(batches):
        table = ids_table(shared.value)
        held: dict[str, list] = {}

        def merged(parts):
            g, n = (np.concatenate(x) for x in zip(*parts))
            order_ = np.argsort(g, kind="stable")
            g, n = g[order_], n[order_]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            return g[first], np.add.reduceat(n, first)

        for batch in batches:
            for part in slices(batch):
                by: dict[str, list[str]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), texts_of(part)):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(n_grams(texts, table, order)[0], return_counts=True))
                    if len(parts) >= 16:
                        held[lang] = [merged(parts)]
        for lang, parts in held.items():
            g, n = merged(parts)
            for i in range(0, len(g), 1 << 17):
                j = i + (1 << 17)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g[i:j])), pa.array(g[i:j]), pa.array(n[i:j])], ["lang", "gram", "c"])

    return trusted.select("lang", "text").mapInArrow(count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def discounts(table: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) from counts of counts; 0.5, 1 and 1.5 where those are missing."""
    n = table.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    known = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    return n.select("lang", *[F.when(known, F.greatest(F.lit(0.0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0)))).otherwise(0.5 * k).alias(f"d{k}") for k in (1, 2, 3)])


def model(trusted: DataFrame, letters: list[int], order: int = ORDER) -> DataFrame:
    """(lang, k, gram, p, g): probability of each n-gram of order k and, where it is a context of order k + 1, its weight."""
    by_order = {order: written(counts(trusted, letters, order), "ngram-counts")}
    for k in range(order - 1, 0, -1):
        by_order[k] = by_order[k + 1].groupBy("lang", F.col("gram").bitwiseAND((1 << (BITS * k)) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    below, out = None, None
    for k in range(1, order + 1):
        table = by_order[k].join(F.broadcast(discounts(by_order[k])), "lang")  # one row a language
        context = F.shiftright("gram", BITS)
        table = table.withColumn("h", context).withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        totals = table.groupBy("lang", "h").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("g"))
        table = table.join(totals, ["lang", "h"])
        if k == 1:
            lower = F.lit(unseen_p(letters))
        else:
            table = table.join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), (table["lang"] == below["lang"]) & (F.col("gram").bitwiseAND((1 << (BITS * (k - 1))) - 1) == F.col("suffix"))).drop(below["lang"])
            lower = F.col("lower")
        probable = table.select("lang", "gram", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("g") * lower).alias("p"))
        below = written(probable, "ngram-probabilities")
        rows = below.select("lang", F.lit(k).alias("k"), "gram", "p", F.lit(False).alias("context")).unionByName(totals.select("lang", F.lit(k).alias("k"), F.col("h").alias("gram"), F.col("g").alias("p"), F.lit(True).alias("context")))
        out = rows if out is None else out.unionByName(rows)
    return written(out, "ngram-model")


class Scorer:
    """The model as sorted arrays: (lang, k, context?) -> n-grams and logarithms, read when first asked for."""

    def __init__(self, folder: str, langs: list[str], letters: list[int], order: int):
        self.folder, self.langs, self.order = folder, langs, order
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.ids = ids_table(letters)
        self.unseen = math.log(unseen_p(letters))

    def _table(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        if part not in self.tables:
            from pyarrow import dataset, fs

            files, path = filesystem(self.folder)
            at = f"{path}/part={part}"
            if files.get_file_info(at).type == fs.FileType.NotFound:
                self.tables[part] = np.empty(0, np.int64), np.empty(0)
            else:
                rows = dataset.dataset(at, filesystem=files, format="parquet").to_table(columns=["gram", "lp"])
                gram = rows.column("gram").to_numpy()
                order = np.argsort(gram, kind="stable")
                self.tables[part] = gram[order], rows.column("lp").to_numpy()[order]
        return self.tables[part]

    def _find(self, lang: str, k: int, context: bool, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self._table(_part(self.langs.index(lang), k, context))
        if not len(keys):
            return np.zeros(len(grams), bool), np.zeros(len(grams))
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        return keys[at] == grams, values[at]

    def log_p(self, lang: str, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        for k in range(self.order, 0, -1):
            gram = grams[left] & ((1 << (BITS * k)) - 1)
            hit, p = self._find(lang, k, False, gram)
            out[left[hit]] += p[hit]
            left, gram = left[~hit], gram[~hit]
            known, g = self._find(lang, k, True, gram >> BITS)
            out[left[known]] += g[known]
            if not len(left):
                return out
        out[left] += self.unseen
        return out

    def perplexities(self, lang: str, texts: list[str]) -> np.ndarray:
        grams, doc = n_grams(texts, self.ids, self.order)
        distinct, back = np.unique(grams, return_inverse=True)
        total = np.bincount(doc, self.log_p(lang, distinct)[back], len(texts))
        return np.exp(-total / np.bincount(doc, minlength=len(texts)))


@lru_cache(2)
def _scorer(shared) -> Scorer:
    return Scorer(*shared.value)


@lru_cache(2)
def _ids(shared) -> np.ndarray:
    return ids_table(shared.value)


def _part(lang: int, k: int, context: bool) -> int:
    return lang << 8 | k << 1 | int(context)


def score_held(docs: DataFrame, fitted: DataFrame, letters: list[int], order: int = ORDER) -> DataFrame:
    """Every worker reads the tables that it needs from the shared folder; nothing passes the driver."""
    spark = docs.sparkSession
    langs = sorted(r[0] for r in fitted.select("lang").distinct().collect())
    folder = fresh_path(spark, "ngram-tables")
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)]) if langs else F.create_map(F.lit(""), F.lit(0))
    part = F.shiftleft(number[F.col("lang")], 8).bitwiseOR(F.shiftleft("k", 1)).bitwiseOR(F.col("context").cast("int"))
    fitted.select(part.alias("part"), "gram", F.log("p").alias("lp")).repartition("part").write.partitionBy("part").parquet(folder)
    shared, known = spark.sparkContext.broadcast((folder, langs, letters, order)), set(langs)

    def score(batches):
        for batch in batches:
            for part in slices(batch):
                langs, texts = part.column("lang").to_pylist(), texts_of(part)
                out = np.full(len(texts), np.nan)
                for lang in set(langs) & known:
                    at = [i for i, x in enumerate(langs) if x == lang]
                    out[at] = _scorer(shared).perplexities(lang, [texts[i] for i in at])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(out, from_pandas=True)], ["doc_id", "lang", "perplexity"])

    return docs.select("doc_id", "lang", "text").mapInArrow(score, "doc_id long, lang string, perplexity double")


def log_probabilities(grams: DataFrame, fitted: DataFrame, order: int, unseen: float) -> DataFrame:
    """(lang, gram, s): the logarithm of each n-gram's probability, by joins with the shards of each order.

    What an order finds is written, so that no order is worked out again for the one below.
    """
    rows = {(r["k"], r["context"]): r["count"] for r in fitted.groupBy("k", "context").count().collect()}

    def shards(k: int, context: bool) -> DataFrame:
        lp = F.coalesce(F.log("p"), F.lit(math.nan))  # a weight of 0 has no logarithm, and isn't a missing one
        out = fitted.where((F.col("k") == k) & (F.col("context") == context)).select("lang", F.col("gram").alias("of"), lp.alias("lp"))
        return maybe_broadcast(out, rows.get((k, context), 0), 40, SHARD_BROADCAST)

    left, done = grams.withColumn("s", F.lit(0.0)), []
    for k in range(order, 0, -1):
        left = left.withColumn("of", F.col("gram").bitwiseAND((1 << (BITS * k)) - 1)).join(shards(k, False), ["lang", "of"], "left")
        left = written(left.select("lang", "gram", "of", (F.col("s") + F.coalesce("lp", F.lit(0.0))).alias("s"), F.col("lp").isNotNull().alias("found")), "ngram-scores")
        done.append(left.where("found").select("lang", "gram", "s"))
        left = left.where("not found").select("lang", "gram", "s", F.shiftright("of", BITS).alias("of")).join(shards(k, True), ["lang", "of"], "left")
        left = left.select("lang", "gram", (F.col("s") + F.coalesce("lp", F.lit(0.0))).alias("s"))
    return reduce(DataFrame.unionByName, done, left.withColumn("s", F.col("s") + unseen))


def score_sharded(docs: DataFrame, fitted: DataFrame, letters: list[int], order: int = ORDER) -> DataFrame:
    """The same by joins: the model never is in one place.

    Documents are dealt into chunks by hash. The distinct n-grams of a chunk, of which there are far fewer than
    signs, are joined with the shards of each order, and what they give comes back to the chunk's documents.
    """
    spark = docs.sparkSession
    chunks = max(1, math.ceil(plan_bytes(docs) / CHUNK_BYTES))
    read = docs.select("doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))
    read = read.join(F.broadcast(fitted.select("lang").distinct()), "lang", "left_semi")  # one row a language
    shared = spark.sparkContext.broadcast(letters)

    def parts(rows: pa.Table):
        for batch in rows.to_batches():
            for part in slices(batch):
                by: dict[str, list[int]] = {}
                for i, lang in enumerate(part.column("lang").to_pylist()):
                    by.setdefault(lang, []).append(i)
                texts = texts_of(part)
                for lang, at in by.items():
                    yield lang, part.column("doc_id").take(pa.array(at)), [texts[i] for i in at]

    def distinct(rows: pa.Table) -> pa.Table:
        table = _ids(shared)
        held: dict[str, list[np.ndarray]] = {}
        for lang, _, texts in parts(rows):
            found = held.setdefault(lang, [])
            found.append(np.unique(n_grams(texts, table, order)[0]))
            if len(found) >= 16:
                held[lang] = [np.unique(np.concatenate(found))]
        grams = {lang: np.unique(np.concatenate(found)) for lang, found in held.items()}
        n = sum(map(len, grams.values()))
        langs = pa.array(np.repeat(np.array(list(grams), object), [len(g) for g in grams.values()]), pa.string())
        return pa.table([pa.array(np.full(n, rows.column("chunk")[0].as_py(), np.int32)), langs, pa.array(np.concatenate([*grams.values(), np.empty(0, np.int64)]))], ["chunk", "lang", "gram"])

    def score(rows: pa.Table, grams: pa.Table) -> pa.Table:
        table, known, out = _ids(shared), {}, []
        if rows.num_rows:
            of, gram, lp = np.array(grams.column("lang").to_pylist(), object), grams.column("gram").to_numpy(), grams.column("s").to_numpy()
            for lang in set(of):
                here = np.flatnonzero(of == lang)
                here = here[np.argsort(gram[here], kind="stable")]
                known[lang] = gram[here], lp[here]
        for lang, ids, texts in parts(rows):
            grams_, doc = n_grams(texts, table, order)
            keys, values = known[lang]
            total = np.bincount(doc, values[np.searchsorted(keys, grams_)], len(texts))
            out.append(pa.table([ids, pa.array([lang] * len(texts)), pa.array(np.exp(-total / np.bincount(doc, minlength=len(texts))), from_pandas=True)], ["doc_id", "lang", "perplexity"]))
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("perplexity", pa.float64())])
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    grams = written(read.groupBy("chunk").applyInArrow(distinct, "chunk int, lang string, gram long"), "ngram-chunks")
    found = written(log_probabilities(grams.select("lang", "gram").distinct(), fitted, order, math.log(unseen_p(letters))), "ngram-found")
    told = written(grams.join(found, ["lang", "gram"]).select("chunk", "lang", "gram", "s"), "ngram-told")
    remove(grams, found)
    return read.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, "doc_id long, lang string, perplexity double")


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, threshold): the least grid point below which a share of ``quantile`` lies."""
    from pyspark.sql import Window

    grid = scored.where("perplexity is not null").groupBy("lang", F.ceil(F.log("perplexity") * GRID).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("lang").orderBy("cell")
    grid = grid.withColumn("up", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    return grid.where(F.col("up") >= quantile * F.col("all")).groupBy("lang").agg(F.exp(F.min("cell") / GRID).alias("threshold"))


def kept_documents(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER, held_ngrams: int = HELD_NGRAMS) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep): the documents that are fluent enough."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    good = written(labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "trusted")
    few = maybe_broadcast(good, good.count(), 16)
    trusted = read.join(few, "doc_id", "left_semi")
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    letters = alphabet(trusted)
    fitted = model(trusted.where(~held_out), letters, order)
    scored = written((score_held if fitted.count() <= held_ngrams else score_sharded)(read, fitted, letters, order), "perplexities")
    judged = scored.join(few, "doc_id", "left_semi")
    limit = thresholds(judged.where(held_out), quantile)
    limit = limit.unionByName(thresholds(judged, quantile).join(limit, "lang", "left_anti"))
    return scored.join(F.broadcast(limit), "lang").where("perplexity <= threshold").select("doc_id", "lang", "perplexity", "threshold", F.lit(True).alias("keep"))


def query(spark, sf_dir: str) -> DataFrame:
    return kept_documents(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def query_in_shards(spark, sf_dir: str) -> DataFrame:
    """The same, scored by joins however small the model is."""
    return kept_documents(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), held_ngrams=0)
