"""Source-script characters left per slide and per deck."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscript import rules
from twinscript.functions.script import count_core_script, count_script_chars, has_script
from twinscript.functions.text import is_nonblank
from twinscript.operators.joins import join_hot
from twinscript.operators.memory import merge_tm

SLIDE = ["deck_id", "part_name"]


def _script_count(text: str, cls: str, strict: bool) -> Column:
    return count_core_script(F.col(text)) if strict else count_script_chars(F.col(text), cls)


def script_chars_by_slide(
    segments: DataFrame, cls: str = rules.SCRIPT_ANY, strict: bool = False, text: str = "text"
) -> DataFrame:
    """Characters of the class per slide; slides without any stay in with zero."""
    return segments.groupBy(*SLIDE).agg(F.sum(_script_count(text, cls, strict)).alias("n_chars"))


def script_chars_total(segments: DataFrame, cls: str = rules.SCRIPT_ANY, strict: bool = False) -> DataFrame:
    """Per-slide rows with deck and corpus totals (null keys).

    ``level`` tells a total from a slide or deck without a name: 0 for a slide, 1 for a
    deck, 3 for the corpus. The rollup runs over the per-slide sums, not over the paragraphs.
    """
    return (
        script_chars_by_slide(segments, cls, strict)
        .rollup(*SLIDE)
        .agg(F.sum("n_chars").alias("n_chars"), F.grouping_id(*SLIDE).cast("int").alias("level"))
    )


def before_after_by_slide(
    before: DataFrame, after: DataFrame, cls: str = rules.SCRIPT_ANY
) -> DataFrame:
    """Characters per slide on both sides, in one aggregation over the union."""
    zero = F.lit(0).cast("long")
    count = count_script_chars(F.col("text"), cls)
    both = before.select(*SLIDE, count.alias("n_before"), zero.alias("n_after")).unionByName(
        after.select(*SLIDE, zero.alias("n_before"), count.alias("n_after"))
    )
    return _with_delta(both)


def before_after_of_pairs(bilingual: DataFrame, cls: str = rules.SCRIPT_ANY) -> DataFrame:
    """The same from rows that hold both texts: one scan."""
    return _with_delta(
        bilingual.select(
            "deck_id",
            F.col("slide").alias("part_name"),
            count_script_chars(F.col("src"), cls).alias("n_before"),
            count_script_chars(F.col("tgt"), cls).alias("n_after"),
        )
    )


def _with_delta(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy(*SLIDE)
        .agg(F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"))
        .withColumn("delta", F.col("n_after") - F.col("n_before"))
    )


def residual_summary(by_slide: DataFrame) -> DataFrame:
    """Total characters and number of slides that still hold some, per deck."""
    return by_slide.groupBy("deck_id").agg(
        F.sum("n_chars").alias("total_chars"),
        F.count_if(F.col("n_chars") > 0).alias("slides_with_residual"),
        F.count("*").alias("slides"),
    )


def top_residual_slides(by_slide: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` slides with most characters; names break ties."""
    return by_slide.filter("n_chars > 0").orderBy(F.desc("n_chars"), *SLIDE).limit(k)


def residual_gate(by_slide: DataFrame, limit: int) -> DataFrame:
    """Per deck: fails when more characters than ``limit`` remain."""
    failed = F.col("remaining") > limit
    return by_slide.groupBy("deck_id").agg(F.sum("n_chars").alias("remaining")).select(
        "deck_id",
        "remaining",
        (~failed).alias("passed"),
        F.when(failed, F.format_string("%d source characters remain (max %d)", "remaining", F.lit(limit)))
        .otherwise(F.format_string("%d source characters remain", "remaining"))
        .alias("reason"),
    )


def residual_locations(bilingual: DataFrame, cls: str = rules.SCRIPT_ANY) -> DataFrame:
    """Every text that still holds source script, with the place it stands."""
    return bilingual.filter(has_script(F.col("tgt"), cls)).select(
        "deck_id", "slide", "idx", F.col("tgt").alias("jp_text"), F.lit("").alias("candidate_en")
    )


def residual_worklist(locations: DataFrame) -> DataFrame:
    """Distinct texts to translate, the first place each one stands, an empty proposal."""
    first = F.min(F.struct("deck_id", "slide", "idx"))
    return (
        locations.groupBy("jp_text")
        .agg(first.alias("at"), F.count("*").alias("n_uses"))
        .select(
            "jp_text",
            F.lit("").alias("proposed_en"),
            F.col("at.deck_id").alias("deck_example"),
            F.col("at.slide").alias("slide_example"),
            "n_uses",
        )
    )


def residual_patch(filled: DataFrame, cls: str = rules.SCRIPT_ANY) -> DataFrame:
    """What a filled worklist (``jp_text, proposed_en``) says to write: ``src, tgt``, one row per text.

    Proposals that are null, blank, the text itself, or still in the source script are
    left out. Of several for a text the most frequent wins, then the first in code-point
    order. Counting comes before any text is chosen, so a text of any number of proposals
    is as many rows as they differ.
    """
    src, tgt = F.col("jp_text"), F.col("proposed_en")
    usable = filled.filter(src.isNotNull() & is_nonblank(tgt) & (src != tgt) & ~has_script(tgt, cls))
    votes = usable.groupBy(src.alias("src"), tgt.alias("tgt")).agg(F.count("*").alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("fewer"), "tgt")).alias("best")
    return votes.groupBy("src").agg(best).select("src", F.col("best.tgt").alias("tgt"))


def patch_bilingual(bilingual: DataFrame, patch: DataFrame) -> DataFrame:
    """Rows with the patched text where their target is a text of the patch, and ``patched``.

    A worklist names texts that hold source script. If all of the patch do, which is looked up, only rows
    whose target does are joined; the others, most of them, are never shuffled.
    """
    fixed = patch.select(F.col("src").alias("tgt"), F.col("tgt").alias("_fixed"))
    scripted = F.coalesce(has_script(F.col("tgt")), F.lit(False))

    def patched(rows: DataFrame, new: Column) -> DataFrame:
        columns = [F.coalesce(new, "tgt").alias("tgt") if c == "tgt" else F.col(c) for c in bilingual.columns]
        return rows.select(*columns, new.isNotNull().alias("patched"))

    if not fixed.filter(F.col("tgt").isNotNull() & ~scripted).isEmpty():
        return patched(join_hot(bilingual, fixed, "tgt", "left"), F.col("_fixed"))
    joined = patched(join_hot(bilingual.filter(scripted), fixed, "tgt", "left"), F.col("_fixed"))
    return joined.unionByName(patched(bilingual.filter(~scripted), F.lit(None).cast("string")))


def patch_memory(tm: DataFrame, patch: DataFrame) -> DataFrame:
    """The memory after a patch: entries whose translation is a patched text get the new one, patched texts an entry.

    A text that is a source of the memory takes the patch too.
    """
    renewed = patch_bilingual(tm.select("src", "tgt"), patch).filter("patched").select("src", "tgt")
    return merge_tm(tm, renewed, patch)


def deck_residual_report(parts: DataFrame, cls: str = rules.SCRIPT_ANY) -> DataFrame:
    """Totals per deck next to each deck's worst slide."""
    by_slide = script_chars_by_slide(parts, cls)
    return by_slide.groupBy("deck_id").agg(
        F.count("*").alias("slides"),
        F.count_if(F.col("n_chars") > 0).alias("slides_with_residual"),
        F.sum("n_chars").alias("total_chars"),
        F.max("n_chars").alias("worst_chars"),
        F.max_by("part_name", F.struct("n_chars", "part_name")).alias("worst_slide"),
    )
