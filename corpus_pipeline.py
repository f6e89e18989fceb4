"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. ``run`` writes each stage's result to the shared
folder and reads it again, so a lost executor never costs more than one stage.

Defined results: a null or empty text, or one without a letter, is rejected by language ID; rows without an id pass line dedup unchanged and leave with
near-dedup, which keeps one document of each group by its id; rows that repeat an id and a text all stay or all go up to packing; ties go to the smallest id; empty tables give no rows; nulls in lang, source and n_chars
stay as they are; columns of the input beyond those of ``documents`` are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iqlake.llm import decontam, language, linededup, neardup, packing
from iqlake.llm.common import drop_table, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document of which line dedup leaves a smaller share of its words goes as well: what is left is the edits of a copy.
LEAST_LEFT = 0.25


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised by a clear margin; the rejected ones go."""
    model = language.fit(docs.where(~language.held_out()))
    carried = docs.select("doc_id", "text", F.col("text").alias("__text"), F.col("lang").alias("__lang"), "source", "n_chars")
    found = language.predict(carried, model, carry=("__text", "__lang", "source", "n_chars"))
    return found.where(~F.col("rejected")).select("doc_id", F.col("__text").alias("text"), F.col("__lang").alias("lang"), "source", "n_chars")


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks leave the later document; a document of which less than ``LEAST_LEFT`` is left goes."""
    cleaned = linededup.dedup_lines(docs.select(*COLUMNS), removed="__removed")
    left = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    kept = cleaned.where((F.col("__removed") == 0) | (left >= LEAST_LEFT * (left + F.col("__removed"))) & (left > 0))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays."""
    kept = materialize(neardup.groups(docs).where("kept").select("doc_id").distinct(), "kept")
    return docs.join(kept.hint("shuffle_hash"), "doc_id", "left_semi").select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = materialize(decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(leaks.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pieces(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", delete_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Compression sizes, alignments and tokenisation can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = given = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if before is not given:
            drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
