"""Groups of consecutive bullet-like segments."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscript.functions.text import strip_tags, strip_text, word_count
from twinscript.operators.ordering import running_totals
from twinscript.operators.segments import ORDER


def is_bullet_like(text: Column) -> Column:
    return text.contains("[li-") | text.contains("•") | ((word_count(text) < 15) & ~text.endswith("."))


def starts_with_gerund(text: Column) -> Column:
    return strip_text(strip_tags(text)).rlike(r"(?U)\A\w+ing\b")


def bullet_groups(segments: DataFrame, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Consecutive bullet-like segments, groups of two and more.

    A group is consecutive, so its first and last index (counted from zero in the
    given order) name all its members. Groups are aggregated as sums; a group of
    any length stays one small row.
    """
    by = ["deck_id"] if by is None else by
    order = ORDER if order is None else order
    bullet = is_bullet_like(F.col("text"))
    ran = running_totals(
        segments.select(*by, *order, bullet.alias("_bullet"), (bullet & starts_with_gerund(F.col("text"))).alias("_gerund")),
        by,
        order,
        {"pos": F.lit(1).cast("long"), "breaks": F.when(F.col("_bullet"), 0).otherwise(1).cast("long")},
    )
    return (
        ran.filter("_bullet")
        .groupBy(*by, "breaks")
        .agg(
            (F.min("pos") - 1).alias("first_index"),
            (F.max("pos") - 1).alias("last_index"),
            F.count("*").alias("n_items"),
            F.count_if("_gerund").alias("n_gerund"),
        )
        .filter("n_items >= 2")
        .select(*by, F.col("breaks").alias("group_id"), "first_index", "last_index", "n_items", "n_gerund")
    )


def parallelism_issues(groups: DataFrame) -> DataFrame:
    """Groups of three and more where some items, not all, start with an -ing word."""
    return groups.filter("n_items >= 3 and n_gerund > 0 and n_gerund < n_items").withColumn(
        "note", F.format_string("Mix of gerunds (%d) and other forms in bullet group", "n_gerund")
    )
