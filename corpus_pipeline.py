"""The corpus pipeline: five filtering and packing stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of ``documents``, in
their order and with their types; further columns of ``docs``, whatever their names, are carried on.

In every stage rows with a null ``doc_id`` or a null text are no one's toxic document, copy or leak:
the filtering stages keep them as they are, and packing leaves them out. Texts of any length are
worked on whole, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm.common import documents, fresh_path
from sluice.llm.decontaminate import decontaminate
from sluice.llm.jaccard_join import one_of_each_group
from sluice.llm.line_dedup import without_repeated_lines
from sluice.llm.packing import packed_documents
from sluice.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    An empty text is never rejected. Rows that repeat a ``doc_id`` are judged each by their text, so equal
    rows stay or go together; a score of exactly 0 stays. Without a toxic label nothing goes.
    """
    return without_toxic(docs, documents(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one edit of an earlier line go, and documents of which only blanks are left.

    Earlier is by (doc_id, line number), which leaves no ties. Rows that repeat a ``doc_id`` are one
    document: the same line in the same place doesn't repeat itself, and all of them lose the line if an
    earlier one has it. Documents that lose no line, empty ones too, stay as they are; ``n_chars``
    follows the text.
    """
    return without_repeated_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest ``doc_id``.

    Texts without a word are no copies of each other and stay. Rows that repeat a ``doc_id`` stay or go
    together: the id with its repeats is one document of a group.
    """
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go.

    Rows that repeat a ``doc_id`` are scanned each on its own. Items with a null id or text are none; an
    empty benchmark removes nothing.
    """
    return decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in bins: (shard, bin, slot, doc_id, start, length).

    Rows that repeat a ``doc_id`` are packed each, those with fewer tokens first; a text without a token
    has no piece.
    """
    return packed_documents(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join), ("benchmark decontamination", decontamination), ("best-fit packing", packing)]

#: The classifier of the first stage is fitted numerically, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
