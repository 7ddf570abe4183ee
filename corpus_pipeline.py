"""The corpus pipeline: quality rules, line dedup, near-duplicate join, suffix-array dedup, packing.

Every stage takes the documents that the one before kept and returns documents (the last one: packed pieces). Texts that
a stage shortens get a new n_chars; a text of which nothing stays is an empty document, not a missing one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.lines import dedup_lines
from stowage.llm.packing import added_tokens, pack
from stowage.llm.quality import kept_documents
from stowage.llm.setjoin import one_of_each_group
from stowage.llm.shared import written
from stowage.llm.suffix import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_text(df: DataFrame, text) -> DataFrame:
    return df.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: the base rule, and cutoffs that reject few good documents in each language."""
    return kept_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines, the first stays."""
    return with_text(dedup_lines(docs, carry=("lang", "source")), F.col("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five words, similarity 0.8)."""
    return one_of_each_group(docs.select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur again go; what is left of a character that was cut goes too."""
    return with_text(remove_repeats(docs, carry=("lang", "source"), as_text=True), F.col("kept"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 1024 tokens."""
    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("suffix dedup", suffix_dedup), ("packing", packing)]

#: The stages' fixpoints, classifiers' bounds and tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents; each result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
