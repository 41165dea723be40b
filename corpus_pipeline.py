"""A training corpus from ``documents`` in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
has kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglantern.llm import jaccard, language, lines, mixing, packing
from loglantern.llm.queries import TARGETS, vocabulary
from loglantern.llm.tables import small_batches, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    small_batches(spark)
    return language.recognised(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document that loses its last line goes."""
    rows = lines.dedup_lines(docs).where("n_lines = 0 OR n_kept > 0")
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its shingles: the smallest doc_id; rows without one stay."""
    others = jaccard.jaccard_classes(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and length classes have their target shares."""
    return mixing.drawn(docs, TARGETS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents' pieces in token windows."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_documents", near_documents),
    ("mixture", mixture),
    ("packed", packed),
]

#: A trained classifier, a tokenizer and iterative fits: not in SQL. Tested stage by stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
