"""Corpus pipeline: language, quality, near-duplicates, repeated passages, packing.

Each stage takes what its predecessor kept and, but for the last, returns the
columns of ``documents``. The last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import language_id, near_copies, packing, quality_rules, substring_dedup
from kindred.llm.queries import WORD_BPE
from kindred.sources.storage import discard, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with an ambiguous one, go."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts stays: the one with the smallest id (none comes last), then text hash, then place in the table."""
    tag = next(n for n in (f"row_{i}" for i in range(len(docs.columns) + 1)) if n not in {c.lower() for c in docs.columns})
    tagged = materialize(docs.withColumn(tag, F.monotonically_increasing_id()), "rows")
    found = near_copies.near_copies(tagged, row_col=tag)
    stay = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "row")).alias("first")).select(F.col("first.row").alias(tag))
    return tagged.join(stay, tag, "left_semi").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; every document stays with what is left."""
    out = substring_dedup.strip_repeats(docs, keep=[c for c in docs.columns if c not in ("doc_id", "text")])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", clean_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL has neither the trained classifier nor the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)  # does nothing to the table of documents itself
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
