"""Length policy over bilingual rows."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscript.functions.length import counts_preserved, expansion_ratio, length_threshold, spill_to_notes
from twinscript.functions.masking import mask_fragile, placeholders, unmask_fragile
from twinscript.functions.text import is_nonblank, let
from twinscript.operators.joins import join_hot
from twinscript.operators.matching import integrity_of_terms


def flag_expansion(bilingual: DataFrame) -> DataFrame:
    """Ratio, whether it is over the limit of its kind, and whether it comes close."""
    return (
        bilingual.withColumn("ratio", expansion_ratio(F.col("src"), F.col("tgt")))
        .withColumn("threshold", length_threshold(F.col("kind")))
        .withColumn("over", F.col("ratio") > F.col("threshold"))
        .withColumn("borderline", ~F.col("over") & (F.col("ratio") > F.col("threshold") * 0.8))
    )


def content_integrity(
    rows: DataFrame, glossary: DataFrame, keys: list[str], stub: str = "stub", notes: str = "notes", strict: bool = False, **kw
) -> DataFrame:
    """Add ``intact``: numbers, links and glossary terms of the source survive in stub and notes."""
    combined = F.concat(F.col(stub), F.lit(" "), F.col(notes))
    checked = integrity_of_terms(rows, glossary, F.col("src"), combined, keys, **kw)
    return checked.withColumn("intact", counts_preserved(F.col("src"), combined, strict) & F.col("terms_kept")).drop(
        "terms_kept"
    )


def length_policy(bilingual: DataFrame, glossary: DataFrame, keys: list[str], **kw) -> DataFrame:
    """Condense, then spill, then flag: one row per segment.

    ``condensed`` is an input column. Texts over their limit take it; when it is
    still too long its overflow moves to notes, unless content would get lost.
    """
    limit = F.col("threshold")
    rated = flag_expansion(bilingual).withColumn("new_ratio", expansion_ratio(F.col("src"), F.col("condensed")))
    long_still = F.col("over") & (F.col("new_ratio") > limit)
    spilled = rated.withColumn(
        "_s", F.when(long_still, spill_to_notes(F.col("condensed"), F.col("kind")))
    ).select(
        "*",
        F.coalesce("_s.stub", F.lit("")).alias("stub"),
        F.coalesce("_s.notes", F.lit("")).alias("spill"),
    )
    checked = content_integrity(spilled, glossary, keys, "stub", "spill", **kw)
    use_spill = long_still & F.col("intact")
    action = (
        F.when(~F.col("over"), "keep").when(~long_still, "condense").when(use_spill, "spill").otherwise("condense_unspilled")
    )
    tightening = (
        F.when(~F.col("over"), F.col("ratio") > limit * 0.8)
        .when(~long_still, F.col("new_ratio") > limit * 0.85)
        .when(use_spill, expansion_ratio(F.col("src"), F.col("stub")) > limit * 0.9)
        .otherwise(True)
    )
    return checked.select(
        *keys,
        "src",
        "ratio",
        action.alias("action"),
        F.when(~F.col("over"), F.col("tgt")).when(use_spill, F.col("stub")).otherwise(F.col("condensed")).alias("text"),
        F.when(use_spill, F.col("spill")).otherwise("").alias("notes"),
        tightening.alias("needs_tightening"),
    )


def spilled_notes_by_slide(segments: DataFrame, notes: DataFrame) -> DataFrame:
    """Overflow text of each slide in paragraph order, joined by blank lines.

    ``notes`` has one row per source text (``src, notes``). A slide is one part of
    one deck file, so its list is bounded by that part.
    """
    wanted = notes.filter(is_nonblank(F.col("notes"))).select(F.col("src").alias("text"), "notes")
    return (
        join_hot(segments.select("deck_id", "part_name", "para_idx", "text"), wanted, "text")
        .groupBy("deck_id", "part_name")
        .agg(F.array_sort(F.collect_list(F.struct("para_idx", "notes"))).alias("_n"))
        .select("deck_id", "part_name", F.array_join(F.transform("_n", lambda n: n["notes"]), "\n\n").alias("notes"))
    )


def mask_round_trip_check(segments: DataFrame, translated: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows whose text does not come back from masking, or whose placeholders changed.

    ``translated`` gives the translation of a masked text (a column of the table
    or an expression); without it the masked text itself is checked.
    """
    text = F.col("text")

    def check(m: Column, after: Column) -> Column:
        # Most texts come back as they went; their placeholders need no comparing.
        unchanged = F.when(after == m["masked"], True)
        return F.struct(
            m["masked"].alias("masked"),
            after.alias("translated"),
            (unmask_fragile(m["masked"], m["marks"]) == text).alias("same_text"),
            unchanged.otherwise(placeholders(after) == placeholders(m["masked"])).alias("same_placeholders"),
        )

    def checked(m: Column) -> Column:
        return let(m["masked"] if translated is None else translated(m["masked"]), lambda after: check(m, after))

    finding = F.filter(
        F.array(let(mask_fragile(text), checked)), lambda c: ~(c["same_text"] & c["same_placeholders"])
    )
    return segments.select("*", F.explode(finding).alias("_c")).select(*segments.columns, "_c.*")
