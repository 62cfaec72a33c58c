"""Operator 5, toxicity: non-negative positive-unlabelled learning on hashed words.

A linear classifier over the set of a text's words and of their first ``HEADS`` characters
(which inflected and compound forms share, so that rare forms are known too) is trained in numpy
from documents confirmed as toxic and from unlabelled ones. The unlabelled ones hold toxic text too, so
the risk of calling them negative is corrected by the class prior ``pi``::

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

with the logistic loss; while the second term is below 0, its gradient is reversed, which
keeps the fit from driving it further down. Weights are 0 or more, and an L1 step leaves
them only on words that matter: a word can speak for toxicity or say nothing, so a long
text is neither condemned nor excused by the sum of many small weights.

The fit uses a bounded sample of the labelled rows: at most ``max_positive`` of those confirmed
as toxic and at most ``max_unlabelled`` of all that ``labels`` covers, taken as unlabelled text
(whatever their label says, so that the prior, the share of toxic ones among all judged rows,
holds for them). Both are chosen by hash of the id over the whole table. Features that fewer than
``min_positives`` of the confirmed documents have, or that aren't ``min_lift`` times as frequent in
them as in unlabelled text, get no weight: they can't speak for toxicity. The prior and the scores
cover all rows. The sample's features are gathered and the fit is done in one executor task; the
driver sees ids and the weights that aren't 0.

Cases: null or empty text is never toxic; without any confirmed toxic document nothing is;
rows of equal ``doc_id`` are scored each on their text, and count once in the fit if they are equal; labels that are null count as
unlabelled; a document labelled several times is toxic if one label says so; labels without
a document are ignored by the fit; texts of any length are scored whole; an empty table gives an
empty result. Other columns are carried on untouched.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, by_text, documents, slices, texts_of, written

BITS = 20
HEADS = (4, 5)
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
MIN_POSITIVES = 5
MIN_LIFT = 1.5


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each distinct word and head of a word, sorted by text."""
    w = Words(texts)
    doc, hashed = [w.doc], [w.hash]
    for k in HEADS:
        longer, head = w.heads(k)
        doc.append(w.doc[longer])
        hashed.append(head)
    pairs = np.unique((np.concatenate(doc).astype(np.int64) << BITS) | (np.concatenate(hashed) >> np.uint64(64 - BITS)).astype(np.int64))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


class Model:
    """Weights of the buckets that have one, and the bias."""

    def __init__(self, buckets: np.ndarray, values: np.ndarray, bias: float):
        self.buckets, self.values, self.bias = buckets.astype(np.int32), values.astype(np.float64), float(bias)

    def __getstate__(self):
        return self.buckets, self.values, self.bias

    def __setstate__(self, state):
        self.buckets, self.values, self.bias = state

    @cached_property
    def weights(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.buckets] = self.values
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log odds of each text; minus infinity without a word."""
        doc, bucket = features(texts)
        out = self.bias + np.bincount(doc, self.weights[bucket], len(texts))
        out[np.bincount(doc, minlength=len(texts)) == 0] = -np.inf
        return out


class Bags:
    """Feature sets of many documents as one flat array, with forward and backward products."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        size = np.fromiter(map(len, sets), np.int64, self.n)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), size)
        self.index = np.concatenate([*sets, np.empty(0, np.int32)]).astype(np.int32)

    def forward(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.index], self.n)

    def backward(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.index, g[self.row], width)


def risk(p: Bags, u: Bags, w: np.ndarray, b: float, prior: float) -> tuple[float, float, np.ndarray, float]:
    """(risk, its part from negatives before clipping at 0, and the step's gradient by weights and bias)."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    softplus = lambda z: np.logaddexp(0, z)
    sp, su = p.forward(w) + b, u.forward(w) + b
    positive, negative = prior * softplus(-sp).mean(), softplus(su).mean() - prior * softplus(sp).mean()
    gn_p, gn_u = -prior * sigmoid(sp) / p.n, sigmoid(su) / u.n
    gp, gu = (-prior * sigmoid(-sp) / p.n + gn_p, gn_u) if negative >= 0 else (-gn_p, -gn_u)
    return positive + max(0.0, negative), negative, p.backward(gp, len(w)) + u.backward(gu, len(w)), gp.sum() + gu.sum()


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, min_positives: int = MIN_POSITIVES, min_lift: float = MIN_LIFT, l1: float = 1e-4, steps: int = 400, rate: float = 0.05) -> Model:
    """Full-batch Adam on the non-negative risk with a one-sided soft threshold after each step."""
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model(np.empty(0), np.empty(0), -1.0)
    seen, around = (np.bincount(np.concatenate(sets), minlength=1 << BITS) for sets in (positive, unlabelled))
    support = (seen >= min(min_positives, max(1, len(positive) // 2))) & (seen * len(unlabelled) >= min_lift * len(positive) * around)
    dense, width = np.cumsum(support, dtype=np.int32) - 1, int(support.sum())
    p, u = (Bags([dense[s[support[s]]] for s in sets]) for sets in (positive, unlabelled))
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        _, _, g, gb = risk(p, u, w, b, prior)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        scale = rate / (np.sqrt(v / c2) + 1e-4)
        w = w - scale * m / c1
        w = np.maximum(w - scale * l1, 0)
        b -= rate * mb / c1 / (np.sqrt(vb / c2) + 1e-4)
    return Model(np.flatnonzero(support)[w > 0], w[w > 0], float(b))


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, min_positives: int = MIN_POSITIVES) -> Model:
    """Fit on documents labelled toxic = 1 against documents of ``labels`` taken as unlabelled.

    The prior, unless given, is the share of toxic ones among all judged documents.
    The sampled ids are at most ``max_positive + max_unlabelled`` and are broadcast.
    """
    spark = docs.sparkSession
    covered = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = covered.where("toxic is not null").agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = {r[0] for r in covered.where("toxic = 1").orderBy(*order).limit(max_positive).select("doc_id").collect()}
    hidden = {r[0] for r in covered.orderBy(*order).limit(max_unlabelled).select("doc_id").collect()}
    sample = spark.createDataFrame([(i, i in chosen, i in hidden) for i in sorted(chosen | hidden)], "doc_id long, positive boolean, unlabelled boolean")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(sample), "doc_id")

    def bag(batches):
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part)
                doc, bucket = features(texts)
                ends = np.searchsorted(doc, np.arange(len(texts) + 1))
                sets = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("positive"), part.column("unlabelled"), pa.array(sets, pa.binary())], ["doc_id", "positive", "unlabelled", "features"])

    def fitted(batches):
        # Rows that repeat are one.
        rows = sorted({r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)) if r[3]}, key=lambda r: (r[0], r[3]))
        sets = [[np.frombuffer(r[3], np.int32) for r in rows if r[role]] for role in (1, 2)]
        model = fit(*sets, prior, min_positives)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(model.buckets, -1), pa.int32()), pa.array(np.append(model.values, model.bias))], ["bucket", "weight"])

    bags = read.mapInArrow(bag, "doc_id long, positive boolean, unlabelled boolean, features binary").repartition(1)
    rows = written(bags.mapInArrow(fitted, "bucket int, weight double"), "toxicity-model").orderBy("bucket").collect()
    bias = next((r[1] for r in rows if r[0] < 0), -1.0)
    rows = [r for r in rows if r[0] >= 0]
    return Model(np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows]), bias)


def toxicity(docs: DataFrame, model: Model) -> Column:
    """Log odds over ``docs.text``; null where the text is null or has no word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        out = by_text(shared.value.scores, texts, float)
        return pa.array(out, pa.float64(), mask=~np.isfinite(out))

    return F.arrow_udf(score, "double")(F.col("text").cast("string"))


def toxic_documents(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """(doc_id, score, toxic): the documents that the classifier rejects. No shuffle."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return read.select("doc_id", toxicity(read, train(docs, labels, **fitting)).alias("score")).where("score > 0").withColumn("toxic", F.lit(True))


def without_toxic(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """``docs`` without those that the classifier rejects; all columns kept."""
    return docs.where(F.coalesce(toxicity(docs, train(docs, labels, **fitting)) <= 0, F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return toxic_documents(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
