"""Equi joins whose left side may have one key in a large share of its rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on ``key`` so that a hot key of ``left`` can be split at run time.

    Adaptive execution splits a skewed partition only when both sides of the join
    come straight out of a shuffle. A ``right`` that was just grouped by the key is
    laid out by it already and would be joined in place, hot partition and all.
    Hashing the key once more as a second join column asks for a layout nobody has
    yet, so both sides are shuffled. A right side that turns out small is still
    broadcast. The hash leads, so rows are sorted by a number before any text is
    compared.
    """
    hashed = F.xxhash64(key)
    return left.withColumn("_hash", hashed).join(right.withColumn("_hash", hashed), ["_hash", key], how).drop("_hash")
