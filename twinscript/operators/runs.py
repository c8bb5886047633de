"""Comparing and merging the memories of several runs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscript.operators.joins import join_hot


def _votes(tm_runs: DataFrame) -> DataFrame:
    return tm_runs.groupBy("src", "tgt").agg(F.count("*").alias("votes"))


def run_disagreement(tm_runs: DataFrame) -> DataFrame:
    """Sources translated in more than one way, one row per translation.

    A source may hold any share of the rows; translations stay rows, so nothing
    is gathered per source.
    """
    votes = _votes(tm_runs)
    several = votes.groupBy("src").agg(F.count("*").alias("n_variants")).filter("n_variants > 1")
    return join_hot(votes, several, "src").select("src", "n_variants", "tgt", "votes")


def run_disagreement_totals(tm_runs: DataFrame) -> DataFrame:
    """How many sources there are, and how many of them differ between runs."""
    per_source = _votes(tm_runs).groupBy("src").agg(F.count("*").alias("n_variants"))
    return per_source.agg(
        F.count("*").alias("unique_sources"),
        F.count_if(F.col("n_variants") > 1).alias("differing_sources"),
        F.max("n_variants").alias("most_variants"),
    )


def consensus_merge(tm_runs: DataFrame) -> DataFrame:
    """The most frequent translation of each source; on a tie the one that sorts first."""
    best = F.min(F.struct((-F.col("votes")).alias("against"), F.col("tgt")))
    return (
        _votes(tm_runs)
        .groupBy("src")
        .agg(best.alias("best"))
        .select("src", F.col("best.tgt").alias("tgt"), (-F.col("best.against")).alias("votes"))
    )


def run_totals(audits: DataFrame) -> DataFrame:
    """Before and after characters of each run over all its decks."""
    return audits.groupBy("run_id").agg(
        F.sum("jp_chars_before").alias("jp_chars_before"),
        F.sum("jp_chars_after").alias("jp_chars_after"),
        F.sum("api_calls").alias("api_calls"),
    )


def best_run(audits: DataFrame) -> DataFrame:
    """The run that leaves fewest characters; the lower id on a tie."""
    return audits.agg(F.min(F.struct("jp_chars_after", "run_id")).alias("best")).select(
        F.col("best.run_id").alias("run_id"), F.col("best.jp_chars_after").alias("jp_chars_after")
    )
