"""Reviewer findings: from JSON to rows, from our own checks, and back into texts."""

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from twinscript import schemas
from twinscript.functions.casing import any_phrase, quoted, whole_word
from twinscript.functions.text import let, strip_tags
from twinscript.operators.audits import bullet_fix, title_case_fix
from twinscript.operators.islands import bullet_groups, parallelism_issues
from twinscript.operators.matching import (
    INLINE_RULES,
    alternative_hits,
    banned_phrase_flags,
    bounded_rows,
    glossary_alternatives,
    listed_alternatives,
    punct_flags,
    usable_rules,
)

# The categories in the order their fixes are applied; the last has none.
CATEGORIES = [
    "title_case_violations",
    "bullet_terminal_punctuation",
    "banned_phrases",
    "punctuation_errors",
    "glossary_violations",
    "parallelism_issues",
]
FLAT = ["batch_id", "index", "category", "stage", "place", "find", "replacement"]


def _finding(category: str, i: Column, index: Column, find: Column, replacement: Column) -> Column:
    return F.struct(
        F.lit(category).alias("category"),
        F.lit(CATEGORIES.index(category)).alias("stage"),
        i.cast("int").alias("place"),
        index.cast("long").alias("index"),
        find.cast("string").alias("find"),
        replacement.cast("string").alias("replacement"),
    )


def parse_diagnostics(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """One row per finding and segment index from JSON replies keyed by ``batch_id``."""
    style = F.from_json(F.col(reply), schemas.DIAGNOSTICS)["style"]
    null = F.lit(None)

    def flat(category: str, find: str | None, replacement: str) -> Column:
        return F.coalesce(
            F.transform(
                F.col(f"_style.{category}"),
                lambda v, i: _finding(category, i, v["index"], v[find] if find else null, v[replacement]),
            ),
            F.array().cast("array<struct<category:string,stage:int,place:int,index:long,find:string,replacement:string>>"),
        )

    groups = F.coalesce(
        F.flatten(
            F.transform(
                F.col("_style.parallelism_issues"),
                lambda v, i: F.transform(v["indices"], lambda n: _finding("parallelism_issues", i, n, null, v["note"])),
            )
        ),
        F.array().cast("array<struct<category:string,stage:int,place:int,index:long,find:string,replacement:string>>"),
    )
    findings = F.concat(
        flat("title_case_violations", None, "suggested_fix"),
        flat("bullet_terminal_punctuation", None, "suggested_fix"),
        flat("banned_phrases", "phrase", "suggested"),
        flat("punctuation_errors", "original", "correct"),
        flat("glossary_violations", "found", "expected"),
        groups,
    )
    return (
        replies.select("batch_id", style.alias("_style"))
        .select("batch_id", F.explode(findings).alias("_f"))
        .select("batch_id", "_f.index", "_f.category", "_f.stage", "_f.place", "_f.find", "_f.replacement")
    )


def tone_flags(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """The tone part of each reply; it is reported and never applied."""
    return replies.select("batch_id", F.from_json(F.col(reply), schemas.DIAGNOSTICS)["tone_flags"].alias("t")).select(
        "batch_id", "t.*"
    )


ITEM = "struct<category:string,stage:int,place:int,find:string,replacement:string>"


def _item(category: str, place: Column | int, find: Column, replacement: Column) -> Column:
    place = F.lit(place) if isinstance(place, int) else place
    return F.struct(
        F.lit(category).alias("category"),
        F.lit(CATEGORIES.index(category)).alias("stage"),
        place.cast("int").alias("place"),
        find.cast("string").alias("find"),
        replacement.cast("string").alias("replacement"),
    )


def _shape_findings(text: Column) -> Column:
    """The findings that need no rule table: title case and closing marks."""
    none = F.array().cast(f"array<{ITEM}>")

    def fix(category: str, wanted: Column) -> Column:
        return let(
            wanted, lambda f: F.when(f.isNotNull(), F.array(_item(category, 0, F.lit(None), f))).otherwise(none)
        )

    return F.concat(fix("title_case_violations", title_case_fix(text)), fix("bullet_terminal_punctuation", bullet_fix(text)))


def row_findings(text: Column, banned: list[Row], marks: list[Row], listed: list[Row]) -> Column:
    """All findings of one text as an array; the rule rows become literal conditions."""
    none = F.array().cast(f"array<{ITEM}>")

    def each(category: str, hits: list[tuple[Column, int, str, str]]) -> Column:
        found = [F.when(hit, _item(category, place, F.lit(find), F.lit(wanted))) for hit, place, find, wanted in hits]
        return F.array_compact(F.array(*found)) if found else none

    def phrases(bare: Column) -> Column:
        hits = [(bare.rlike(whole_word(r["phrase"])), r["place"], r["phrase"], r["suggested"]) for r in banned]
        any_hit = bare.rlike(any_phrase([r["phrase"] for r in banned])) if banned else F.lit(False)
        return F.when(any_hit, each("banned_phrases", hits)).otherwise(none)

    def terms(bare: Column) -> Column:
        return F.transform(
            alternative_hits(F.lower(bare), listed),
            lambda h: _item("glossary_violations", 0, h["found"], h["expected"]),
        )

    return F.concat(
        _shape_findings(text),
        let(strip_tags(text), lambda bare: F.concat(phrases(bare), terms(bare))),
        each("punctuation_errors", [(text.contains(r["original"]), r["place"], r["original"], r["correct"]) for r in marks]),
    )


def _inline_rules(
    banned: DataFrame, marks: DataFrame, listed: DataFrame, inline: int
) -> tuple[list[Row], list[Row], list[Row]] | None:
    """The rows of all three tables, or None when one of them is too large to inline."""
    usable = usable_rules(banned, "phrase", word="phrase"), usable_rules(marks, "original"), listed
    rows = tuple(bounded_rows(t, inline) for t in usable)
    return None if any(r is None for r in rows) else rows


def style_diagnostics(
    segments: DataFrame,
    banned: DataFrame,
    marks: DataFrame,
    glossary: DataFrame,
    alternatives: DataFrame,
    inline: int = INLINE_RULES,
) -> DataFrame:
    """The checks run on segments ``(batch_id, index, text)`` in the rows of :func:`parse_diagnostics`.

    ``banned`` and ``marks`` carry ``place``, the order their fixes are applied in.
    Small rule tables take one scan for all checks; otherwise each table is joined in
    a scan of its own, and one more serves the checks without a table.
    """
    keys = ["batch_id", "index"]
    columns = ["category", "stage", "place", "find", "replacement"]
    small = _inline_rules(banned, marks, listed_alternatives(glossary, alternatives), inline)
    if small is not None:
        return segments.select(*keys, F.explode(row_findings(F.col("text"), *small)).alias("_f")).select(*keys, "_f.*")

    def rows(df: DataFrame, category: str, place: Column | int, find: Column, replacement: Column) -> DataFrame:
        return df.select(*keys, _item(category, place, find, replacement).alias("_f")).select(
            *keys, *[f"_f.{c}" for c in columns]
        )

    bare = segments.withColumn("_tgt", strip_tags(F.col("text")))
    parts = [
        segments.select(*keys, F.explode(_shape_findings(F.col("text"))).alias("_f")).select(*keys, *[f"_f.{c}" for c in columns]),
        rows(
            banned_phrase_flags(segments, banned, inline=inline),
            CATEGORIES[2], F.col("place"), F.col("phrase"), F.col("suggested"),
        ),
        rows(punct_flags(segments, marks, inline=inline), CATEGORIES[3], F.col("place"), F.col("original"), F.col("correct")),
        rows(
            glossary_alternatives(bare, glossary, alternatives, keys, text="_tgt", inline=inline),
            CATEGORIES[4], 0, F.col("found"), F.col("expected"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def parallelism_findings(segments: DataFrame) -> DataFrame:
    """Bullet groups of a batch with mixed first words: batch, first and last index, note."""
    return parallelism_issues(bullet_groups(segments, by=["batch_id"], order=["index"]))


def _literal_regex(text: Column) -> Column:
    """``text`` as a whole-word pattern that ignores case."""
    return F.concat(F.lit(r"(?iU)\b"), quoted(text), F.lit(r"\b"))


def _literal_replacement(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def _apply_one(text: Column, fix: Column) -> Column:
    return (
        F.when(fix["stage"] <= 1, F.coalesce(fix["replacement"], text))
        .when(fix["stage"] == 3, F.replace(text, fix["find"], fix["replacement"]))
        .otherwise(F.regexp_replace(text, _literal_regex(fix["find"]), _literal_replacement(fix["replacement"])))
    )


def apply_diagnostics(segments: DataFrame, findings: DataFrame) -> DataFrame:
    """Apply the fixes of each segment in category order; unknown indexes fall away.

    Findings meet by batch and index. They come from one reply or from the rule
    tables, so a segment's list stays as small as those.
    """
    fixes = (
        findings.filter(F.col("category") != "parallelism_issues")
        .groupBy("batch_id", "index")
        .agg(F.array_sort(F.collect_list(F.struct("stage", "place", "find", "replacement"))).alias("_fixes"))
    )
    fixed = F.when(F.col("_fixes").isNull(), F.col("text")).otherwise(
        F.aggregate(F.col("_fixes"), F.col("text"), _apply_one)
    )
    return segments.join(fixes, ["batch_id", "index"], "left").withColumn("fixed", fixed).drop("_fixes")


def check_and_fix(
    segments: DataFrame,
    banned: DataFrame,
    marks: DataFrame,
    glossary: DataFrame,
    alternatives: DataFrame,
    inline: int = INLINE_RULES,
) -> DataFrame:
    """Run the checks and apply their fixes; with small rule tables nothing is shuffled."""
    small = _inline_rules(banned, marks, listed_alternatives(glossary, alternatives), inline)
    if small is None:
        return apply_diagnostics(segments, style_diagnostics(segments, banned, marks, glossary, alternatives, inline))
    text = F.col("text")
    ordered = F.array_sort(
        F.transform(
            row_findings(text, *small),
            lambda f: F.struct(f["stage"].alias("stage"), f["place"].alias("place"), f["find"].alias("find"),
                               f["replacement"].alias("replacement")),
        )
    )
    return segments.withColumn("fixed", F.aggregate(ordered, text, _apply_one))
