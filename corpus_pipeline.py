"""From raw documents to packed sequences: quality, exact copies, near copies, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of `documents`. No stage has an SQL form (a learned model, shingle links, a knapsack and a tokenizer).

In every stage texts of any length are read whole, a null text counts as empty, a null doc_id is no reason to drop a
row, no rows give no rows, and further columns come out as they went in, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import exact_dedup, mixing, ngram_join, packing, quality
from corvane.llm.common import written
from corvane.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality classifier accepts. It learns from the marks of these documents.

    A row is judged by its text alone, empty ones too, so repeated rows and equal texts stay or go together. A score
    of exactly the threshold is accepted. Without marks of both kinds nothing is learned and every row stays.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted_rows(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts.

    The largest doc_id stays; a null one is below all others. Of repeated rows the last in the files' order stays. All
    null and empty texts are one group.
    """
    return exact_dedup.keep_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links: five-word shingles, Jaccard 0.8 or more.

    The least doc_id of a component stays; rows that repeat a doc_id stay or go together, and rows without one stay.
    Texts without words link with nothing and stay. With fewer than five words the whole sequence is the only shingle.
    """
    return ngram_join.keep_rows(docs, k=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight; a document that is taken several times is as many rows.

    Documents without words are never taken. A null source is a source of its own, the last. Repeated rows are documents
    of their own; ties between equal seeded hashes go by (doc_id, text), so reruns take the same texts.
    """
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of binary length, one per piece.

    An empty text is its end id alone. Repeated rows are packed one by one. A null doc_id stays null.
    """
    return packing.packed(docs, tokenizer_path())


STAGES = [("quality", quality_filter), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", source_mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
