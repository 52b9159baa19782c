"""The corpus pipeline: quality, lines, near duplicates, benchmark passages, packing.

Each stage takes all that its predecessor kept and returns the columns of documents, the last one packed pieces.
Stages drop rows or lines only by their own decision; a row with a null doc_id is dropped by quality or
benchmark passages alone. A text that lost lines has its `n_chars` counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuetrace.llm import decontaminate, jaccard, lines, packing, quality
from cuetrace.llm.jobs import store, table
from cuetrace.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier takes for junk or toxic."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.filter(quality.accepted()).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that many documents hold, but for the last document that holds them."""
    left = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates."""
    found = jaccard.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(store(found, "near-duplicates"), "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents' ids in sequences of 1024."""
    packed = packing.pack(docs, tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer have no SQL form; tests hold the other stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
