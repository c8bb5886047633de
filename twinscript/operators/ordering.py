"""Positions and running totals inside groups of any size.

A plain window sends a whole group through one task. These operators cut the
ordered data into ranges first, so that one deck may hold any share of all rows:
a range boundary falls inside a large group like anywhere else.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.session import staged


def _offsets(per_chunk: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """What the earlier ranges of a group add up to.

    Only groups that span ranges get a row, and each range but the first can
    continue at most one group. The result has fewer rows than there are ranges,
    whatever the data holds, so it may be broadcast.
    """
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select(
        *by, "_chunk", F.count("*").over(earlier).alias("_n"), *[F.sum(n).over(earlier).alias(f"_before_{n}") for n in names]
    ).filter("_n > 0").drop("_n")


def _attach(rows: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    """Join the offsets to the rows of their range; a null group is a group too."""
    keys = [*by, "_chunk"]
    side = offsets.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return rows.join(F.broadcast(side), same, "left").drop(*[f"_of_{k}" for k in keys])


def number_rows(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``row_number`` by group, exact: a running count over ranges of the order."""
    return running_totals(df, by, order, {name: F.lit(1).cast("long")})


def running_totals(df: DataFrame, by: list[str], order: list[str], totals: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums by group, in the given order."""
    names = list(totals)
    ranged = staged(
        df.withColumns(totals).repartitionByRange(*by, *order).withColumn("_chunk", F.spark_partition_id()),
        "running-totals",
    )
    per_chunk = ranged.groupBy(*by, "_chunk").agg(*[F.sum(n).alias(n) for n in names])
    before = _offsets(per_chunk, by, names)
    inside = (
        Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = ranged.withColumns({n: F.sum(n).over(inside) for n in names})
    return (
        _attach(summed, before, by)
        .withColumns({n: F.col(n) + F.coalesce(f"_before_{n}", F.lit(0)) for n in names})
        .drop("_chunk", *[f"_before_{n}" for n in names])
    )
