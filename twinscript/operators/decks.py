"""Audit records and formatting statistics of whole decks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscript import rules
from twinscript.functions.script import has_script
from twinscript.operators.residual import before_after_of_pairs
from twinscript.operators.segments import part_number

SLIDES_PER_PAGE = 1000


def deck_totals(
    bilingual: DataFrame,
    before_after: DataFrame | None = None,
    n_missing: DataFrame | None = None,
    batch_size: int = rules.TRANSLATE_BATCH,
) -> DataFrame:
    """Distinct source strings, calls, and characters before and after, per deck.

    ``before_after`` are the per-slide counts when they are at hand already.
    ``n_missing`` (``deck_id, n_missing``) is what was sent; without it every
    distinct string was. Texts are made distinct before they are counted.
    """
    by_slide = before_after_of_pairs(bilingual) if before_after is None else before_after
    chars = by_slide.groupBy("deck_id").agg(
        F.sum("n_before").alias("jp_chars_before"), F.sum("n_after").alias("jp_chars_after")
    )
    unique = (
        bilingual.filter(has_script(F.col("src")))
        .groupBy("deck_id", "src")
        .agg(F.count("*").alias("n_uses"))
        .groupBy("deck_id")
        .agg(F.count("*").alias("unique_strings"))
    )
    sent = n_missing if n_missing is not None else unique.select("deck_id", F.col("unique_strings").alias("n_missing"))
    none = F.lit(0).cast("long")
    return (
        chars.join(unique, "deck_id", "left")
        .join(sent, "deck_id", "left")
        .select(
            "deck_id",
            F.coalesce("unique_strings", none).alias("unique_strings"),
            F.ceil(F.coalesce("n_missing", none) / batch_size).cast("long").alias("api_calls"),
            "jp_chars_before",
            "jp_chars_after",
        )
    )


def deck_audit(
    bilingual: DataFrame,
    n_missing: DataFrame | None = None,
    batch_size: int = rules.TRANSLATE_BATCH,
    slides_per_page: int = SLIDES_PER_PAGE,
) -> DataFrame:
    """The audit record of each deck with its two per-slide maps.

    A record holds the slides of one page: slide number div ``slides_per_page``.
    An ordinary deck is one record; a deck of millions of slides becomes many
    records, and no task ever builds a map over all of them.
    """
    by_slide = before_after_of_pairs(bilingual)
    totals = deck_totals(bilingual, by_slide, n_missing, batch_size)
    # A part without a number gets a page of its own.
    number = F.coalesce(part_number(F.col("part_name")), F.xxhash64("part_name"))
    paged = (
        by_slide.withColumn("page", F.floor(number / slides_per_page).cast("long"))
        .groupBy("deck_id", "page")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("part_name", "n_before"))).alias("per_slide_before"),
            F.map_from_entries(F.collect_list(F.struct("part_name", "n_after"))).alias("per_slide_after"),
        )
    )
    return paged.join(totals, "deck_id").select(
        "deck_id", "page", "unique_strings", "api_calls", "jp_chars_before", "jp_chars_after",
        "per_slide_before", "per_slide_after",
    )


def format_counts(runs: DataFrame) -> DataFrame:
    """Per slide, how often each combination of formatting values is used.

    Counts merge before and after a shuffle; a slide of any number of runs is as many
    rows as it has combinations.
    """
    return runs.groupBy(
        "deck_id", "part_name", "record", "is_title", "font_family", "font_size", "margins", "line_spacing"
    ).agg(F.count("*").alias("n"))


def _repeated(value: str) -> Column:
    """The values of all records, ascending, from their counts."""
    counted = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("n").alias("n")))))
    return F.flatten(F.transform(counted, lambda c: F.array_repeat(c["v"], c["n"].cast("int"))))


def format_stats(runs: DataFrame) -> DataFrame:
    """Per slide: frames by role, its fonts, and the sizes, margins and spacings of all records.

    ``runs`` has one ``frame`` record per text frame, one ``spacing`` record per
    spaced paragraph and one ``run`` record per styled run. Records are counted by
    value first (:func:`format_counts`).
    """
    frames = lambda more: F.coalesce(F.sum(F.when((F.col("record") == "frame") & more, F.col("n"))), F.lit(0))
    return format_counts(runs).groupBy("deck_id", "part_name").agg(
        frames(F.lit(True)).alias("text_frames"),
        frames(F.col("is_title")).alias("title_frames"),
        frames(~F.col("is_title")).alias("body_frames"),
        F.array_sort(F.collect_set("font_family")).alias("font_families"),
        _repeated("font_size").alias("font_sizes"),
        _repeated("margins").alias("margin_settings"),
        _repeated("line_spacing").alias("line_spacings"),
    )
