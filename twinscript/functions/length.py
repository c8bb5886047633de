"""Length ratio, its limits, and moving overflow to notes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinscript import rules
from twinscript.functions.text import collapse_whitespace, let, strip_text, words


def expansion_ratio(src: Column, tgt: Column) -> Column:
    """Target length over source length, both trimmed; 1.0 for an empty source."""
    n_src = F.length(strip_text(src))
    return F.when(n_src > 0, F.length(strip_text(tgt)) / n_src).otherwise(F.lit(1.0))


def length_threshold(kind: Column) -> Column:
    limits = F.lit(rules.LENGTH_LIMIT_DEFAULT)
    for name, limit in rules.LENGTH_LIMITS.items():
        limits = F.when(kind == name, F.lit(limit)).otherwise(limits)
    return limits


def _stub(text: Column, notes: Column) -> Column:
    return F.struct(text.alias("stub"), notes.alias("notes"))


def _first(ws: Column, n: int) -> Column:
    return F.array_join(F.slice(ws, 1, n), " ")


def _rest(parts: Column, start: int | Column) -> Column:
    """Everything from position ``start`` on, joined by a space."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.array_join(F.slice(parts, start, F.greatest(F.size(parts) - start + 1, F.lit(0))), " ")


def _fallback(text: Column) -> Column:
    return let(
        words(text),
        lambda ws: F.when(
            F.size(ws) > 8,
            _stub(F.concat(_first(ws, 6), F.lit(" (→Notes)")), F.concat(F.lit("Complete text: "), text)),
        ).otherwise(_stub(text, F.lit(""))),
    )


def _spill_title(text: Column) -> Column:
    # Whole words that fit 75 characters when each counts one more for its space.
    kept = F.regexp_extract(F.concat(collapse_whitespace(text), F.lit(" ")), r"\A(.{0,74}) ", 1)
    return F.when(
        F.length(text) > 80,
        _stub(F.concat(kept, F.lit("...")), F.concat(F.lit("Full title: "), text)),
    ).otherwise(_fallback(text))


def _spill_bullet(text: Column) -> Column:
    detail = F.lit(" (detail → Notes)")
    sentences = F.split(text, r"(?U)(?<=[.!?;])\s+", -1)
    clauses = F.split(text, r"(?U)\s*(?:,\s*(?:and|but|or)|;\s*)\s*", -1)

    def keep_first(parts: Column) -> Column:
        return _stub(
            F.concat(parts.getItem(0), detail),
            F.concat(F.lit("Additional details: "), _rest(parts, 2)),
        )

    def halves(ws: Column) -> Column:
        half = F.floor(F.size(ws) / 2).cast("int")
        return _stub(
            F.concat(F.array_join(F.slice(ws, F.lit(1), half), " "), F.lit(" (more → Notes)")),
            F.concat(F.lit("Continued: "), _rest(ws, half + 1)),
        )

    return let(
        sentences,
        lambda ss: F.when(F.size(ss) > 1, keep_first(ss)).otherwise(
            let(
                clauses,
                lambda cs: F.when(F.size(cs) > 1, keep_first(cs)).otherwise(let(words(text), halves)),
            )
        ),
    )


def _spill_table(text: Column) -> Column:
    return let(
        words(text),
        lambda ws: F.when(
            F.size(ws) > 5,
            _stub(F.concat(_first(ws, 3), F.lit("... (Notes)")), F.concat(F.lit("Full content: "), text)),
        ).otherwise(_stub(text, F.lit(""))),
    )


def spill_to_notes(text: Column, kind: Column) -> Column:
    """``struct(stub, notes)``: a short text to keep and the overflow."""
    return (
        F.when(kind == "title", _spill_title(text))
        .when(kind == "bullet", _spill_bullet(text))
        .when(kind == "table", _spill_table(text))
        .otherwise(_fallback(text))
    )


def spill_last_sentence(text: Column, overflow: Column | None = None) -> Column:
    """Variant that keeps all but the last sentence."""
    overflow = F.lit("") if overflow is None else overflow
    return let(
        F.split(text, r"(?U)(?<=[.!?])\s+", -1),
        lambda ss: F.when(
            F.size(ss) > 1,
            _stub(
                F.concat(F.array_join(F.slice(ss, F.lit(1), F.size(ss) - 1), " "), F.lit(" (details → Notes)")),
                F.concat(F.lit("Additional details:\n"), F.element_at(ss, -1), F.lit("\n"), overflow),
            ),
        ).otherwise(_stub(text, overflow)),
    )


def counts_preserved(src: Column, combined: Column, strict: bool = False) -> Column:
    """Same number of numbers and links; ``strict`` compares their values."""
    def links(text: Column) -> Column:
        # Most texts hold none and need no pattern; a null one counts null.
        without = ~(text.contains("://") | text.contains("www."))
        return F.when(without, 0).otherwise(F.regexp_count(text, F.lit(rules.COUNTED_URL)))

    if not strict:
        return (
            F.regexp_count(src, F.lit(rules.COUNTED_NUMBER)) == F.regexp_count(combined, F.lit(rules.COUNTED_NUMBER))
        ) & (links(src) == links(combined))

    def values(text: Column, pattern: str) -> Column:
        return F.array_sort(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    return (values(src, rules.COUNTED_NUMBER) == values(combined, rules.COUNTED_NUMBER)) & (
        values(src, rules.COUNTED_URL) == values(combined, rules.COUNTED_URL)
    )
