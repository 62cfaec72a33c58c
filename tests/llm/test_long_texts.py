"""Texts of more than a batch of characters, in every operator (the first and the third are in test_operators)."""

import numpy as np
import pytest

from sluice.llm import fingerprint, jaccard_join, line_dedup, packing, quality, records, token_counts, toxicity
from sluice.llm.common import CHUNK_CHARS, DEFAULT_RANKS, encode, tokenizer

from .test_operators import LONG, table

SHORT = "lorem w1x w2x é lorem w1x"


@pytest.fixture(scope="module")
def tokens():
    return {1: len(encode(tokenizer(DEFAULT_RANKS), LONG)), 2: len(encode(tokenizer(DEFAULT_RANKS), SHORT)), 3: 0}


def docs(spark, *more):
    assert len(LONG) > CHUNK_CHARS
    return table(spark, [(1, LONG), (2, SHORT), (3, ""), *more], "doc_id long, text string, lang string")


def test_perplexity(spark):
    """A text of one passage over and over is read to its end: so is the same with junk behind it."""
    trusted = table(spark, [(1, SHORT * 3, "en"), (2, "w2x é lorem", "en")], "doc_id long, text string, lang string")
    letters = quality.alphabet(trusted)
    fitted = quality.model(trusted, letters)
    texts = table(spark, [(1, LONG, "en"), (2, LONG + "qzqz" * 300_000, "en"), (3, SHORT, "en")], "doc_id long, text string, lang string")
    held, sharded = ({r["doc_id"]: r["perplexity"] for r in score(texts, fitted, letters).collect()} for score in (quality.score_held, quality.score_sharded))
    assert held == pytest.approx(sharded) and held[2] > 2 * held[1]


def test_packing(spark, tokens):
    out = packing.packed_documents(docs(spark)).collect()
    assert sum(r["length"] for r in out if r["doc_id"] == 1) == tokens[1] + 1 and all(r["length"] <= packing.CAPACITY for r in out)
    assert sorted(r["start"] for r in out if r["doc_id"] == 1) == list(range(0, tokens[1] + 1, packing.CAPACITY))


def test_toxicity(spark):
    model = toxicity.Model(toxicity.features(["vile"])[1], np.array([4.0] * len(toxicity.features(["vile"])[1])), -3.0)
    texts = docs(spark, (4, LONG + " vile"), (5, "vile " + LONG))
    assert {r["doc_id"] for r in texts.withColumn("s", toxicity.toxicity(texts, model)).where("s > 0").collect()} == {4, 5}


def test_fingerprints(spark):
    rng = np.random.default_rng(1)
    long = fingerprint.render(rng.normal(0, 0.2, 2_100))
    assert len(long) > CHUNK_CHARS
    start = 1000 * fingerprint.HOP
    media = [(1, fingerprint.wav(long)), (2, fingerprint.wav(long[start : start + 40_000]))]
    prints = fingerprint.fingerprints(table(spark, media, "id long, media binary"))
    found = fingerprint.alignments(prints).collect()
    assert {(r["query"], r["id"]): r["offset"] for r in found} == {(1, 2): 1000, (2, 1): -1000}


def test_token_counts(spark, tokens):
    assert {tuple(r) for r in token_counts.token_counts(docs(spark)).collect()} == set(tokens.items())


def test_lines(spark):
    line = LONG + "qqq"
    found = line_dedup.repeated_lines(table(spark, [(1, line), (2, "x\n" + line), (3, line[:700_000] + "z" + line[700_000:]), (4, line + "zz")], "doc_id long, text string"))
    assert {tuple(r) for r in found.collect()} == {(2, 1, 1, 0, 0), (3, 0, 1, 0, 1)}


def test_records(spark, tmp_path):
    folder = f"file://{tmp_path}/r"
    index = records.write_records(docs(spark), folder)
    back = {r["doc_id"]: r["ids"] for r in records.read_records(index, folder).collect()}
    assert back == {i: encode(tokenizer(DEFAULT_RANKS), t).tolist() for i, t in ((1, LONG), (2, SHORT), (3, ""))}


def test_near_duplicates(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(160_000)) for c in "ab")
    changed = one[: len(one) // 2] + " changed " + one[len(one) // 2 :]
    found = jaccard_join.near_duplicates(table(spark, [(1, one), (2, changed), (3, other), (4, one + "!"), (5, SHORT)], "doc_id long, text string"))
    assert len(one) > CHUNK_CHARS and {tuple(r) for r in found.collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 1, 2), (5, 5, 0)}
