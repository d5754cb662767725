"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and but for the last returns the columns of
``docs``. ``run`` writes the result of each stage to the shared folder and reads it again for the next.

Nulls, empty texts, repeated rows, empty tables and other columns: as the operators define them. Null and empty texts fail the quality base test, so
they end at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, mixing, near_copies, quality_rules, token_files
from barloom.llm.common import stage
from barloom.llm.queries import table, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test and the learned list keep. Statistics are taken once; the list is learned from those of the labelled documents."""
    labels = table(spark, sf_dir, "labels").filter("quality is not null").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("_b_bad"))
    measured = quality_rules.measured(docs)
    labelled = quality_rules.plain_statistics(measured, "doc_id").join(labels, "doc_id")
    rules = quality_rules.learn(labelled, "_b_bad", F.col("doc_id"))
    return quality_rules.passing(measured, rules)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word Jaccard similarity of 0.8 or more, confirmed exactly."""
    return near_copies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken, the last one of a source cut at the budget."""
    return mixing.mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and per document what they hold: doc_id, start, n_tokens, ids_crc32."""
    return token_files.round_trip(docs, tokenizer_path())


STAGES = [
    ("quality rules", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-id output", write_tokens),
]

# Learned rules, XXH64 fingerprints and a tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline")
    return docs
