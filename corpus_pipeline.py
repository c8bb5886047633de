"""The corpus pipeline: quality rules, near and substring duplicates, mixing, packing."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from twinscript.llm import mixing, packing, quality, simhash, substrings
from twinscript.llm.tables import read, staged
from twinscript.session import drop_stages, owned_stages

OWNER = "pipeline"


def _applied(operator: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """``operator`` of ``docs``. A predecessor's result has been written by now: whatever it staged goes first."""
    drop_stages(docs.sparkSession, docs, owner=OWNER)
    with owned_stages(OWNER):
        return operator(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _applied(quality.keep_good, docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return _applied(simhash.keep_one, docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur elsewhere too are taken out."""
    return _applied(substrings.without_repeats, docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that the sources meet their weights."""
    return _applied(mixing.mixed, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    return _applied(lambda d: packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json")), docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

# Hash tables, tokens and the permutation have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what its predecessor kept, written and read again in between."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            with owned_stages(OWNER):
                docs = staged(docs, f"pipeline-{name}")
    return docs
