"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all documents that the stage
before it kept, and returns a DataFrame; all but the last return the columns
of ``documents``.  ``run`` writes each stage as Parquet into the shared folder
of ``spark.checkpoint.dir`` and reads it again, so that a lost executor costs
at most the stage at hand.

Odd input, in every stage: null and empty texts have no words, fail the quality
rules and go there; texts of any length are taken whole; rows without id are told
apart by their texts, and rows that repeat id and text are copies, of which
near-dedup keeps one; ties go to the smaller id; an empty table stays empty; further
columns pass through to the end, whatever their names (mixing adds ``copy`` and
``shuffle_key``), but for ``__n_lines``, ``__n_removed``, ``__copy`` and ``__order``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import decontaminate, linededup, mixing, quality, simhash
from panelcast.llm.common import read_table
from panelcast.session import checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learnt cutoffs reject go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated windows go; a document all of whose lines occur earlier goes with them."""
    cleaned = linededup.dedup_lines(docs)
    emptied = (F.col("__n_removed") > 0) & (F.col("__n_removed") == F.col("__n_lines") )
    n_chars = F.when(F.col("__n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")
    return cleaned.where(~emptied).select(
        *[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are replicated to the target mix of sources and shuffled."""
    return mixing.mix(docs).withColumnsRenamed({"__copy": "copy", "__order": "shuffle_key"})


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

# XXH64 majorities and reachability have no plain SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
