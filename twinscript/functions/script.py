"""Source-script detection. ``cls`` is the body of a regex bracket expression."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinscript import rules


def has_script(text: Column, cls: str = rules.SCRIPT_ANY) -> Column:
    return text.rlike(f"[{cls}]")


def count_script_chars(text: Column, cls: str = rules.SCRIPT_ANY) -> Column:
    """Characters of the class: what the text loses when its runs of them are taken out.

    Counting matches one by one would build an array with a string per character.
    """
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{cls}]+", ""))).cast("long")


def count_core_script(text: Column) -> Column:
    """Strict count: lexical characters only."""
    return count_script_chars(F.translate(text, rules.NON_LEXICAL_MARKS, ""), rules.SCRIPT_CORE)


def extract_script_chars(text: Column, cls: str = rules.SCRIPT_CORE) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(f"[{cls}]"), F.lit(0)), "")


def is_identity_entry(src: Column, tgt: Column) -> Column:
    return F.coalesce(src == tgt, F.lit(False))


def is_unusable_entry(src: Column, tgt: Column, cls: str = rules.SCRIPT_ANY) -> Column:
    """Missing, unchanged, or still holding source script."""
    return tgt.isNull() | is_identity_entry(src, tgt) | F.coalesce(has_script(tgt, cls), F.lit(False))
