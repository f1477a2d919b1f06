"""A training corpus from raw documents: rules, lines, near-duplicates, benchmark passages, pieces.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as
Parquet to the folder in ``spark.checkpoint.dir`` and hands what it reads back to the next.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notecoder.llm import contamination, lines, minhash, pieces, quality
from notecoder.llm.shared import read, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule."""
    return quality.judged(docs, prefix="__").where("__kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; documents that consisted of such lines only go."""
    return lines.without_recurring_lines(docs).where("not emptied").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles, the one with the least id."""
    judged = minhash.near_duplicates(docs, words=5, percent=80)
    stay = written(judged.where("kept").select(F.col("row_key").alias("__k")).distinct(), "stay")
    rows = docs.withColumn("__k", F.xxhash64("doc_id", "text"))
    # repeated rows have one key and become one row
    return rows.join(stay.hint("merge"), "__k", "left_semi").dropDuplicates(["__k"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return contamination.checked(docs, read(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, ids and decoded text, and digests of both."""
    return pieces.encoded(docs.select("doc_id", "text"), full=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Exact piece encoding has no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
