"""Style issues of bilingual rows, the report over all of them, and the gates.

Every check is a list of findings computed from the row itself. One check alone
or all of them together cost one scan without a shuffle; only terminology looks
across rows.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscript import rules
from twinscript.functions.casing import title_case, title_case_tagged
from twinscript.functions.script import extract_script_chars, has_script
from twinscript.functions.text import (
    TERMINAL,
    classify_kind_by_length,
    classify_segment_kind,
    is_nonblank,
    let,
    preview,
    sentence_marks,
    strip_tags,
    strip_text,
    word_count,
)
from twinscript.operators.matching import banned_matches, inconsistent_terms, term_variant_uses

ROW = ["deck_id", "slide", "idx"]


def with_kind(bilingual: DataFrame) -> DataFrame:
    """Add the audit's kind: short targets are titles, others bullets."""
    return bilingual.withColumn("kind", classify_kind_by_length(F.col("tgt")))


def ends_like_sentence(bare: Column) -> Column:
    """Ends in ``. ; :`` without being several sentences."""
    return bare.rlike(TERMINAL) & (sentence_marks(bare) <= 1)


def found_in(rows: DataFrame, keys: list[str], finding: Column) -> DataFrame:
    """Rows whose ``finding`` (array of structs, or null) holds something, one row per entry.

    Exploding evaluates a finding once. A filter on a computed column would be
    pushed below its projection and compute it a second time.
    """
    return rows.select(*keys, F.explode(finding).alias("_f")).select(*keys, "_f.*")


def audit_title_case(bilingual: DataFrame) -> DataFrame:
    """Titles that differ from their title case."""
    tgt, bare = F.col("tgt"), strip_tags(F.col("tgt"))
    finding = let(
        F.struct(bare.alias("bare"), title_case(bare).alias("cased")),
        lambda t: F.when(
            t["bare"] != t["cased"],
            F.array(F.struct(preview(tgt).alias("text"), preview(t["cased"]).alias("expected"))),
        ),
    )
    return found_in(bilingual.filter((F.col("kind") == "title") & is_nonblank(tgt)), ROW, finding)


def audit_bullet_punct(bilingual: DataFrame) -> DataFrame:
    """Bullets that end in a closing mark; the tail of the text is shown."""
    tgt = F.col("tgt")
    finding = let(
        strip_text(strip_tags(tgt)),
        lambda bare: F.when(ends_like_sentence(bare), F.array(F.struct(F.right(bare, F.lit(20)).alias("text")))),
    )
    return found_in(bilingual.filter((F.col("kind") == "bullet") & is_nonblank(tgt)), ROW, finding)


def audit_residual(bilingual: DataFrame, cls: str = rules.SCRIPT_CORE) -> DataFrame:
    """Targets that still hold source script, with those characters."""
    return bilingual.filter(has_script(F.col("tgt"), cls)).select(
        *ROW, extract_script_chars(F.col("tgt"), cls).alias("jp_chars"), preview(F.col("tgt")).alias("text")
    )


def audit_length(
    bilingual: DataFrame, max_title_words: int = rules.TITLE_MAX_WORDS, max_bullet_chars: int = rules.BULLET_MAX_CHARS
) -> DataFrame:
    """Titles with too many words and bullets with too many characters."""
    title = F.col("kind") == "title"

    def finding(bare: Column) -> Column:
        size = F.when(title, word_count(bare)).otherwise(F.length(bare)).cast("long")
        limit = F.when(title, max_title_words).otherwise(max_bullet_chars)
        kind = F.when(title, "title_too_long").otherwise("bullet_too_long")
        return let(
            size,
            lambda n: F.when(
                n > limit, F.array(F.struct(kind.alias("issue_type"), n.alias("size"), preview(bare).alias("text")))
            ),
        )

    audited = bilingual.filter(F.col("kind").isin("title", "bullet"))
    return found_in(audited, ROW, let(strip_text(strip_tags(F.col("tgt"))), finding))


def opened_tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[([^/][^\]]*)\]"), F.lit(1))


def closed_tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[/([^\]]+)\]"), F.lit(1))


def tags_union(bilingual: DataFrame) -> DataFrame:
    """Distinct tags of each deck, opened or closed."""
    tgt = F.col("tgt")
    both = F.array_union(opened_tags(tgt), closed_tags(tgt))
    return bilingual.filter(tgt.contains("[")).select("deck_id", F.explode(both).alias("tag")).distinct()


def unbalanced_tags(text: Column) -> Column:
    """``array<struct(tag, open_count, close_count)>`` of tags whose counts differ."""
    opened, closed = opened_tags(text), closed_tags(text)

    def compare(both: Column) -> Column:
        counts = F.transform(
            F.array_union(both["opened"], both["closed"]),
            lambda tag: F.struct(
                tag.alias("tag"),
                F.size(F.filter(both["opened"], lambda t: t == tag)).cast("long").alias("open_count"),
                F.size(F.filter(both["closed"], lambda t: t == tag)).cast("long").alias("close_count"),
            ),
        )
        return F.filter(counts, lambda c: c["open_count"] != c["close_count"])

    return let(F.struct(opened.alias("opened"), closed.alias("closed")), compare)


def tag_balance(bilingual: DataFrame) -> DataFrame:
    """One row per segment and tag that opens and closes a different number of times."""
    return (
        bilingual.filter(F.col("tgt").contains("["))
        .select(*ROW, F.explode(unbalanced_tags(F.col("tgt"))).alias("_t"), "tgt")
        .select(*ROW, "_t.tag", "_t.open_count", "_t.close_count", preview(F.col("tgt")).alias("text"))
    )


def _issue(category: str, issue_type: Column | str, description: Column, fix: Column | str) -> Column:
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        F.lit(category).alias("category"),
        as_column(issue_type).alias("issue_type"),
        description.alias("description"),
        as_column(fix).alias("suggested_fix"),
    )


def _text(fmt: str, *args: Column) -> Column:
    return F.format_string(fmt, *args)


def row_issues(tgt: Column, kind: Column, banned: dict[str, str]) -> Column:
    """All issues of one row as an array of (category, type, description, fix)."""
    title, bullet = kind == "title", kind == "bullet"
    none = F.filter(F.array(_issue("", "", F.lit(""), "")), lambda _: F.lit(False))

    def only_if(condition: Column, issue: Column) -> Column:
        return F.when(condition, F.array(issue)).otherwise(none)

    def capitalization(bare: Column) -> Column:
        cased = let(
            title_case(bare),
            lambda want: only_if(
                want != bare,
                _issue(
                    "capitalization_issues",
                    "title_case",
                    _text("Title not in Title Case: '%s'", preview(tgt)),
                    preview(want),
                ),
            ),
        )
        return F.when(title & is_nonblank(tgt), cased).otherwise(none)

    def closing_mark(trimmed: Column) -> Column:
        return only_if(
            bullet & is_nonblank(tgt) & ends_like_sentence(trimmed),
            _issue(
                "bullet_punctuation_issues",
                "bullet_punct",
                _text("Bullet ends with punctuation: '%s'", F.right(trimmed, F.lit(20))),
                "Remove terminal punctuation",
            ),
        )

    def phrases(bare: Column) -> Column:
        if not banned:
            return none
        return F.transform(
            banned_matches(bare, banned),
            lambda m: _issue(
                "banned_word_issues",
                "banned_word",
                _text("Banned word '%s' found", m["word"]),
                _text("Replace with '%s'", m["suggested"]),
            ),
        )

    def length(trimmed: Column) -> Column:
        fix = "Condense text or apply expansion policy"
        title_words, bullet_chars = F.lit(rules.TITLE_MAX_WORDS), F.lit(rules.BULLET_MAX_CHARS)
        return (
            F.when(
                title & (word_count(trimmed) > title_words),
                F.array(
                    _issue(
                        "length_violations",
                        "title_too_long",
                        _text("Title too long: %d words (max %d)", word_count(trimmed), title_words),
                        fix,
                    )
                ),
            )
            .when(
                bullet & (F.length(trimmed) > bullet_chars),
                F.array(
                    _issue(
                        "length_violations",
                        "bullet_too_long",
                        _text("Bullet too long: %d chars (max %d)", F.length(trimmed), bullet_chars),
                        fix,
                    )
                ),
            )
            .otherwise(none)
        )

    residual = only_if(
        has_script(tgt, rules.SCRIPT_CORE),
        _issue(
            "japanese_residual",
            "japanese_residual",
            _text("Japanese characters remain: %s", extract_script_chars(tgt)),
            "Re-translate remaining Japanese",
        ),
    )
    tags = F.when(
        tgt.contains("["),
        F.transform(
            unbalanced_tags(tgt),
            lambda t: _issue(
                "formatting_tag_issues",
                "unbalanced_tags",
                _text("Unbalanced tag [%s]: %d open, %d close", t["tag"], t["open_count"], t["close_count"]),
                _text("Balance [%s] tags", t["tag"]),
            ),
        ),
    ).otherwise(none)
    bare = F.when(tgt.contains("["), strip_tags(tgt)).otherwise(tgt)
    of_text = let(
        F.struct(bare.alias("bare"), strip_text(bare).alias("trimmed")),
        lambda t: F.concat(
            capitalization(t["bare"]), closing_mark(t["trimmed"]), phrases(t["bare"]), length(t["trimmed"])
        ),
    )
    return F.concat(of_text, residual, tags)


def all_issues(
    bilingual: DataFrame,
    glossary: DataFrame | None = None,
    alternatives: DataFrame | None = None,
    banned: dict[str, str] | None = None,
) -> DataFrame:
    """Every issue of every row in the report's columns, plus ``deck_id``.

    Rows are scanned once. Terms with several renderings add one row per deck and
    term when a glossary is given.
    """
    banned = rules.BANNED_PHRASES if banned is None else banned
    found = (
        bilingual.select(*ROW, F.explode(row_issues(F.col("tgt"), F.col("kind"), banned)).alias("_i"))
        .select("deck_id", "_i.category", "slide", "idx", "_i.issue_type", "_i.description", "_i.suggested_fix")
    )
    if glossary is None or alternatives is None:
        return found
    terms = (
        inconsistent_terms(term_variant_uses(bilingual, glossary, alternatives))
        .select(
            "deck_id",
            F.lit("terminology_issues").alias("category"),
            F.lit("").alias("slide"),
            F.lit(None).cast("long").alias("idx"),
            F.lit("terminology_inconsistency").alias("issue_type"),
            _text("Term '%s' rendered in %d ways", F.col("term"), F.col("n_variants")).alias("description"),
            F.lit("Review manually").alias("suggested_fix"),
        )
    )
    return found.unionByName(terms)


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues per category, and overall in the row without a category."""
    return issues.groupBy("category").agg(F.count("*").alias("n")).rollup("category").agg(F.sum("n").alias("n_issues"))


def quality_gate(
    issues: DataFrame,
    max_issues: int = rules.GATE_MAX_ISSUES,
    critical: list[str] | None = None,
    decks: DataFrame | None = None,
) -> DataFrame:
    """Pass or fail per deck with the first reason that applies.

    ``decks`` (``deck_id``) adds decks without any issue.
    """
    critical = rules.CRITICAL_CATEGORIES if critical is None else critical
    counts = issues.groupBy("deck_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("issue_type") == "unbalanced_tags").alias("unbalanced"),
        *[F.count_if(F.col("category") == c).alias(f"critical_{i}") for i, c in enumerate(critical)],
    )
    if decks is not None:
        counts = decks.select("deck_id").distinct().join(counts, "deck_id", "left").na.fill(0)
    reason: Callable | Column = F.when(F.lit(False), "")
    for i, c in enumerate(critical):
        n = F.col(f"critical_{i}")
        reason = reason.when(n > 0, _text(f"Critical issues found in {c}: %d issues", n))
    reason = reason.when(
        F.col("unbalanced") > 0, _text("Critical issues found in unbalanced_tags: %d issues", F.col("unbalanced"))
    ).when(
        F.col("total") > max_issues,
        _text("Too many style issues: %d (max allowed: %d)", F.col("total"), F.lit(max_issues)),
    )
    return counts.select("deck_id", "total", reason.alias("_r")).select(
        "deck_id",
        F.col("total").alias("total_issues"),
        F.col("_r").isNull().alias("passed"),
        F.coalesce("_r", _text("Style audit passed: %d issues found", F.col("total"))).alias("reason"),
    )


def title_case_fix(text: Column) -> Column:
    """The tagged title case of a short text that differs from it, else null."""
    return F.when(
        classify_segment_kind(text) == "title",
        let(title_case_tagged(text), lambda want: F.when(want != text, want)),
    )


def bullet_fix(text: Column) -> Column:
    """A marked or short text without its closing mark, or null when there is none too many."""
    def fix(bare: Column) -> Column:
        marked = text.contains("[li-") | text.contains("•")
        fragment = (word_count(bare) < 15) & (F.regexp_count(bare, F.lit(r"\.")) <= 1)
        open_end = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+\z", ""), TERMINAL, "")
        return F.when((marked | fragment) & ends_like_sentence(bare), F.regexp_replace(open_end, r"(?U)\s+\z", ""))

    return let(strip_text(strip_tags(text)), fix)


def _fixes(segments: DataFrame, keys: list[str], text: str, fix: Column) -> DataFrame:
    finding = let(fix, lambda f: F.when(f.isNotNull(), F.array(F.struct(f.alias("suggested_fix")))))
    return found_in(segments, [*keys, text], finding).withColumnRenamed(text, "text")


def check_title_case(segments: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The checker's title rule with its fix."""
    return _fixes(segments, keys, text, title_case_fix(F.col(text)))


def check_bullet_punct(segments: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The checker's bullet rule with its fix."""
    return _fixes(segments, keys, text, bullet_fix(F.col(text)))
