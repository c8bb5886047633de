"""Building, filtering and ordering paragraph tables."""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.functions.text import is_nonblank, strip_text, unescape_markup

ORDER = ["part_name", "para_idx"]


def split_paragraphs(parts: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of ``text``; blank lines drop out and the index keeps counting them."""
    keep = [c for c in parts.columns if c != text]
    return filter_nonblank(
        parts.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("para_idx", "text")).withColumn(
            "para_idx", F.col("para_idx").cast("long")
        )
    )


def filter_nonblank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(is_nonblank(F.col(text)))


def slide_bounds(spec: str | None) -> tuple[int, int] | None:
    """``'3-7'`` as numbers; a spec without exactly one dash means every slide."""
    pieces = (spec or "").split("-")
    return (int(pieces[0]), int(pieces[1])) if len(pieces) == 2 else None


def filter_slide_range(segments: DataFrame, spec: str | None) -> DataFrame:
    """Keep slides ``a..b``, both ends included, by the number in the part name.

    A table with ``part_no`` has that number as a column, and the filter reaches the scan.
    """
    bounds = slide_bounds(spec)
    if bounds is None:
        return segments
    if "part_no" in segments.columns:
        return segments.filter(F.col("part_no").between(*bounds))
    number = F.regexp_extract("part_name", r"(?i)slide(\d+)\.xml", 1)
    return segments.filter((number != "") & number.try_cast("long").between(*bounds))


def order_slides(df: DataFrame, natural: bool = False) -> DataFrame:
    """By part name as text (``slide10`` before ``slide2``) or by its number."""
    return df.orderBy("deck_id", "part_no" if natural else "part_name")


def extract_text_blocks(
    df: DataFrame,
    markup: str,
    element_rx: str = r"(?s)<a:t>(.*?)</a:t>",
    break_rx: str = r"<a:br\s*/>",
    unescape: Column | None = None,
) -> DataFrame:
    """Text blocks of a markup column: element bodies joined, split on blank lines.

    Works on slides and notes alike; pass both as rows (:func:`union_slide_notes`).
    """
    keep = [c for c in df.columns if c != markup]
    bodies = F.regexp_extract_all(F.regexp_replace(markup, break_rx, "\n"), F.lit(element_rx), F.lit(1))
    joined = unescape_markup(F.array_join(bodies, "")) if unescape is None else unescape
    lines = F.regexp_replace(joined, r"\r\n|\r|\n", "\n")
    blocks = F.filter(F.transform(F.split(lines, r"\n{2,}", -1), strip_text), lambda b: b != "")
    return df.select(*keep, F.posexplode(blocks).alias("block_idx", "text")).withColumn(
        "block_idx", F.col("block_idx").cast("long")
    )


def union_slide_notes(slides: DataFrame, notes: DataFrame) -> DataFrame:
    """Slides and notes as one table, told apart by ``part_kind``."""
    return slides.withColumn("part_kind", F.lit("slide")).unionByName(notes.withColumn("part_kind", F.lit("notes")))


def sample_first_blocks(blocks: DataFrame, cls: str, n: int = 10) -> DataFrame:
    """The first ``n`` blocks with source script of each deck, joined by a rule.

    The rank filter becomes a group limit below the shuffle, so a task sends at
    most ``n`` rows of a deck however large the deck is.
    """
    order = Window.partitionBy("deck_id").orderBy(F.desc("part_kind"), "part_name", "block_idx")
    first = (
        blocks.filter(F.col("text").rlike(f"[{cls}]"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )
    return first.groupBy("deck_id").agg(
        F.count("*").alias("n_blocks"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda r: r["text"]), "\n\n---\n\n"
        ).alias("sample"),
    )


def part_number(part_name: Column) -> Column:
    return F.regexp_extract(part_name, r"(\d+)\.xml$", 1).try_cast("long")


def is_slide_name(name: str) -> bool:
    return name.startswith("ppt/slides/slide") and name.endswith(".xml")


def is_notes_name(name: str) -> bool:
    return name.startswith("ppt/notesSlides/notesSlide") and name.endswith(".xml")


def slide_no(name: str) -> int | None:
    found = re.search(r"slide(\d+)\.xml", name, re.IGNORECASE)
    return int(found.group(1)) if found else None
