"""The registered queries against their SQL, and the pipeline against a brute-force version."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import queries, toxicity
from sluice.llm.common import DEFAULT_RANKS, documents, encode, tokenizer

from ..compare import DATA, assert_same
from .test_operators import brute_pairs, brute_spans, groups, prose, without_lines


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert assert_same(queries.QUERIES[name](spark, str(DATA / "sf0.001")), queries.ORACLES[name], "sf0.001") > 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, str(DATA / "sf0.001")).count() > 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(20)
    rows = [(i, "\n".join(prose(rng, rng.randrange(5, 25)) for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    item = prose(rng, 20)
    rows += [(100 + i, prose(rng, 10) + " vile slur filth scum") for i in range(20)]
    rows += [(200, rows[0][1]), (201, rows[1][1].replace("w1", "w2", 1)), (202, prose(rng, 9) + " " + item), (203, rows[2][1].split("\n")[0]), (204, ""), (205, None), (None, prose(rng, 7))]
    rows += [(300 + i, " ".join(rows[5][1].split()[:-1]) + " " * i + f" end{i}") for i in range(3)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(100 + i, 0, 1) for i in range(10)] + [(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = documents(spark, str(tmp_path))
    rejected = {r["doc_id"] for r in toxicity.toxic_documents(docs, documents(spark, str(tmp_path), "labels")).collect()}
    assert rejected >= {100 + i for i in range(19)} and not rejected & set(range(60))
    kept = without_lines([r for r in rows if r[0] not in rejected])
    gone = groups(brute_pairs(kept))
    kept = [r for r in kept if r[0] not in gone]
    leaking = {d for d, *_ in brute_spans(kept, [(1, item)])}
    assert leaking == {202}
    bpe = tokenizer(DEFAULT_RANKS)
    expected = Counter({d: len(encode(bpe, t)) + 1 for d, t in kept if d is not None and t and d not in leaking})
    got = Counter()
    for r in found:
        got[r["doc_id"]] += r["length"]
    assert got == expected


def test_stages_keep_columns(spark):
    docs = documents(spark, str(DATA / "sf0.001"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(DATA / "sf0.001")).columns == docs.columns
        assert stage(spark, docs.limit(0), str(DATA / "sf0.001")).isEmpty()


def test_stages_with_clashing_columns_and_repeated_rows(spark):
    """Names that the stages use themselves, and every row twice: what stays stays twice, with all it holds."""
    sf = str(DATA / "sf0.001")
    docs = documents(spark, sf)
    names = ["h", "k", "class", "label", "__gone", "__id", "part", "score", "line", "line_no", "first", "a", "doc_id_"]
    more = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names}).withColumn("x.y", F.lit(1))
    twice = more.unionByName(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = Counter(r["doc_id"] for r in stage(spark, docs, sf).collect()), stage(spark, twice, sf)
        assert out.schema == twice.schema, name
        found = out.select("doc_id", *names, "`x.y`").collect()
        assert Counter(r["doc_id"] for r in found) == Counter({d: 2 * n for d, n in plain.items()}), name
        assert all(r[n] == f"{n}{r['doc_id']}" for r in found for n in names) and all(r["x.y"] == 1 for r in found)


def test_shards_give_the_same(spark):
    """Operator 2 with its model held and with joins on shards."""
    sf = str(DATA / "sf0.001")
    held, sharded = ({r["doc_id"]: (r["lang"], round(r["perplexity"], 6), round(r["threshold"], 6)) for r in queries.QUERIES[q](spark, sf).collect()} for q in ("op2_quality", "quality_in_shards"))
    assert held == sharded and held
