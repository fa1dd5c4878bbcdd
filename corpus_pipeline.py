"""Corpus pipeline: toxicity, language, exact dedup, near-duplicate join, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs.  All but
the last return the columns of documents.  Rows with null texts, null ids, repeated rows,
empty tables and extra columns pass as the operators define: a null text is empty, is of
no known language and goes in the second stage; of repeated rows one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, lang_id, ngram_join, packing, toxicity
from tidemark.llm.common import discard, materialize, read_table, scratch_path, unused, written
from tidemark.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the PU classifier, learnt from labels, scores below its threshold."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel classifier takes for a language it has learnt."""
    return lang_id.keep_known(docs, lang_id.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest id (null ids last), of each component of near-duplicates.

    Rows count by themselves: where an id is null or repeats, rows are numbered first, so that rows that share an
    id but not a text are each in the component of their own text.  Texts without words
    are near to nothing and stay; empty tables pass; all columns of docs stay as they are."""
    row, id_, component = unused(docs, "row"), F.col("doc_id").cast("long"), unused(docs, "component")
    plain = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()
    rows = docs.withColumn(row, id_) if plain else materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = materialize(ngram_join.similarity_components(rows, id_col=row), "near").select(F.col("doc_id").alias(row), F.col("component_id").alias(component))
    if not plain:  # the component's smallest id, not its smallest number
        low = rows.select(row, "doc_id").join(found, row).groupBy(component).agg(F.min_by(row, F.struct(id_.isNull(), id_, F.col(row))).alias("_low"))
        found = found.join(low, component).select(row, F.col("_low").alias(component))
    gone = found.where(F.col(row) != F.col(component)).select(row)
    return rows.join(gone, row, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("packing", pack),
]

#: Learnt classifiers and tokenizers are beyond SQL; tests hold the last three stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table goes once the next one's is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            discard(spark, before)
        before = path
    return docs
