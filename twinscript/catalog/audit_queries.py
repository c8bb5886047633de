"""Style audit, report and gate."""

from pyspark.sql import functions as F

from twinscript.catalog import sql as q
from twinscript.catalog import workloads as w
from twinscript.catalog.registry import query
from twinscript.operators import audits, decks, matching
from twinscript.plans import flows

ROW = "deck_id, slide, idx"
_BARE = f"rows AS (SELECT *, {q.untag('tgt')} AS bare, {q.strip(q.untag('tgt'))} AS trimmed FROM bilingual)"
_CASED = f"cased AS (SELECT *, {q.title_case('bare')} AS want FROM rows WHERE kind = 'title' AND {q.nonblank('tgt')})"
_BULLETS = (
    f"bullets AS (SELECT * FROM rows WHERE kind = 'bullet' AND {q.nonblank('tgt')} AND regexp_matches(trimmed, '[.:;]$') "
    f"AND {q.marks('trimmed')} <= 1)"
)


@query("audit_title_case", q.using(f"SELECT {ROW}, {q.preview('tgt')} AS text, {q.preview('want')} AS expected FROM cased WHERE bare <> want", _BARE, _CASED))
def audit_title_case(spark, sf_dir):
    return audits.audit_title_case(w.bilingual(spark, sf_dir))


@query("audit_bullet_punct", q.using(f"SELECT {ROW}, right(trimmed, 20) AS text FROM bullets", _BARE, _BULLETS))
def audit_bullet_punct(spark, sf_dir):
    return audits.audit_bullet_punct(w.bilingual(spark, sf_dir))


@query(
    "audit_residual",
    q.using(f"SELECT {ROW}, {q.script_chars('tgt')} AS jp_chars, {q.preview('tgt')} AS text FROM bilingual WHERE {q.has('tgt', q.CORE)}"),
)
def audit_residual(spark, sf_dir):
    return audits.audit_residual(w.bilingual(spark, sf_dir))


_LONG = (
    "long_rows AS (SELECT *, CASE kind WHEN 'title' THEN 'title_too_long' ELSE 'bullet_too_long' END AS issue_type, "
    f"CASE kind WHEN 'title' THEN {q.n_words('trimmed')} ELSE length(trimmed) END AS size FROM rows "
    f"WHERE (kind = 'title' AND {q.n_words('trimmed')} > 12) OR (kind = 'bullet' AND length(trimmed) > 200))"
)


@query("audit_length", q.using(f"SELECT {ROW}, issue_type, size, {q.preview('trimmed')} AS text FROM long_rows", _BARE, _LONG))
def audit_length(spark, sf_dir):
    return audits.audit_length(w.bilingual(spark, sf_dir))


_TAGS = (
    "tags AS (SELECT *, len(list_filter(opened, lambda x: x = tag)) AS open_count, len(list_filter(closed, lambda x: x = tag)) AS close_count FROM ("
    "SELECT *, unnest(list_distinct(list_concat(opened, closed))) AS tag FROM ("
    "SELECT *, regexp_extract_all(tgt, '\\[([^/][^\\]]*)\\]', 1) AS opened, regexp_extract_all(tgt, '\\[/([^\\]]+)\\]', 1) AS closed FROM rows)))"
)


@query(
    "tag_balance",
    q.using(
        f"SELECT {ROW}, tag, open_count, close_count, {q.preview('tgt')} AS text FROM tags WHERE open_count <> close_count",
        _BARE, _TAGS,
    ),
)
def tag_balance(spark, sf_dir):
    return audits.tag_balance(w.bilingual(spark, sf_dir))


@query("tags_union", q.using("SELECT DISTINCT deck_id, tag FROM tags", _BARE, _TAGS))
def tags_union(spark, sf_dir):
    return audits.tags_union(w.bilingual(spark, sf_dir))


_LOW = f"low AS (SELECT *, lower(bare) AS b FROM rows)"
_TERMS = (
    "term_rows AS (SELECT deck_id, term, count(DISTINCT variant) AS n_variants FROM low JOIN (SELECT term, expected AS variant FROM glossary UNION "
    "SELECT term, alt FROM glossary JOIN alternatives USING (term)) ON contains(b, lower(variant)) GROUP BY deck_id, term)"
)
_ISSUES = (
    "issues AS ("
    f"SELECT deck_id, 'capitalization_issues' AS category, slide, idx, 'title_case' AS issue_type, 'Title not in Title Case: ''' || {q.preview('tgt')} || '''' AS description, {q.preview('want')} AS suggested_fix FROM cased WHERE bare <> want UNION ALL "
    "SELECT deck_id, 'bullet_punctuation_issues', slide, idx, 'bullet_punct', 'Bullet ends with punctuation: ''' || right(trimmed, 20) || '''', 'Remove terminal punctuation' FROM bullets UNION ALL "
    f"SELECT deck_id, 'banned_word_issues', slide, idx, 'banned_word', 'Banned word ''' || word || ''' found', 'Replace with ''' || coalesce(suggested, 'review') || '''' FROM (SELECT *, unnest({q.phrase_matches('bare')}) AS word FROM rows) LEFT JOIN banned ON phrase = lower(word) UNION ALL "
    f"SELECT deck_id, 'japanese_residual', slide, idx, 'japanese_residual', 'Japanese characters remain: ' || {q.script_chars('tgt')}, 'Re-translate remaining Japanese' FROM rows WHERE {q.has('tgt', q.CORE)} UNION ALL "
    "SELECT deck_id, 'formatting_tag_issues', slide, idx, 'unbalanced_tags', 'Unbalanced tag [' || tag || ']: ' || open_count || ' open, ' || close_count || ' close', 'Balance [' || tag || '] tags' FROM tags WHERE open_count <> close_count UNION ALL "
    "SELECT deck_id, 'length_violations', slide, idx, issue_type, CASE issue_type WHEN 'title_too_long' THEN 'Title too long: ' || size || ' words (max 12)' ELSE 'Bullet too long: ' || size || ' chars (max 200)' END, 'Condense text or apply expansion policy' FROM long_rows UNION ALL "
    "SELECT deck_id, 'terminology_issues', '', NULL, 'terminology_inconsistency', 'Term ''' || term || ''' rendered in ' || n_variants || ' ways', 'Review manually' FROM term_rows WHERE n_variants > 1)"
)
_ALL = (_BARE, _CASED, _BULLETS, _LONG, _TAGS, _LOW, _TERMS, _ISSUES)


def _issues(spark, sf_dir):
    return audits.all_issues(
        w.bilingual(spark, sf_dir), w.glossary(spark), matching.alternatives_table(spark, w.ALTERNATIVES), w.BANNED
    )


@query("all_issues", q.using("SELECT * FROM issues", *_ALL))
def all_issues(spark, sf_dir):
    return _issues(spark, sf_dir)


@query(
    "issue_counts",
    q.using("SELECT category, count(*) AS n_issues FROM issues GROUP BY ROLLUP (category)", *_ALL),
)
def issue_counts(spark, sf_dir):
    return audits.issue_counts(_issues(spark, sf_dir))


_GATE = (
    "SELECT deck_id, total AS total_issues, reason IS NULL AS passed, "
    "coalesce(reason, 'Style audit passed: ' || total || ' issues found') AS reason FROM ("
    "SELECT deck_id, total, CASE {critical} WHEN unbalanced > 0 THEN 'Critical issues found in unbalanced_tags: ' || unbalanced || ' issues' "
    "WHEN total > {limit} THEN 'Too many style issues: ' || total || ' (max allowed: {limit})' END AS reason FROM ("
    "SELECT deck_id, count(*) AS total, count(*) FILTER (category = 'japanese_residual') AS c0, "
    "count(*) FILTER (category = 'formatting_tag_issues') AS c1, count(*) FILTER (issue_type = 'unbalanced_tags') AS unbalanced "
    "FROM issues GROUP BY deck_id))"
)


@query(
    "quality_gate",
    q.using(
        _GATE.format(
            critical="WHEN c0 > 0 THEN 'Critical issues found in japanese_residual: ' || c0 || ' issues' "
            "WHEN c1 > 0 THEN 'Critical issues found in formatting_tag_issues: ' || c1 || ' issues'",
            limit=10,
        ),
        *_ALL,
    ),
)
def quality_gate(spark, sf_dir):
    return audits.quality_gate(_issues(spark, sf_dir))


@query(
    "style_audit",
    q.using(
        "SELECT 'gate' AS part, deck_id, NULL AS category, total AS n, total <= 1000 AND unbalanced = 0 AS passed FROM (SELECT deck_id, count(*) AS total, "
        "count(*) FILTER (issue_type = 'unbalanced_tags') AS unbalanced FROM issues GROUP BY deck_id) "
        "UNION ALL SELECT 'counts', NULL, category, count(*), NULL FROM issues GROUP BY ROLLUP (category) "
        "UNION ALL SELECT 'issues', deck_id, NULL, count(*), NULL FROM issues GROUP BY deck_id",
        *_ALL,
    ),
)
def style_audit(spark, sf_dir):
    """The flow's three results in one table."""
    out = flows.style_audit(
        w.bilingual(spark, sf_dir), w.glossary(spark), matching.alternatives_table(spark, w.ALTERNATIVES), w.BANNED, max_issues=1000, critical=[]
    )
    none = lambda kind: F.lit(None).cast(kind)
    gate = out.gate.select(F.lit("gate").alias("part"), "deck_id", none("string").alias("category"), F.col("total_issues").alias("n"), "passed")
    counts = out.counts.select(F.lit("counts").alias("part"), none("string").alias("deck_id"), "category", F.col("n_issues").alias("n"), none("boolean").alias("passed"))
    issues = out.issues.groupBy("deck_id").agg(F.count("*").alias("n"))
    listed = issues.select(F.lit("issues").alias("part"), "deck_id", none("string").alias("category"), "n", none("boolean").alias("passed"))
    return gate.unionByName(counts).unionByName(listed)


@query("quality_gate_without_critical", q.using(_GATE.format(critical="WHEN false THEN ''", limit=1000), *_ALL))
def quality_gate_without_critical(spark, sf_dir):
    return audits.quality_gate(_issues(spark, sf_dir), max_issues=1000, critical=[])


_TOTALS = (
    f"totals AS (SELECT deck_id, count(DISTINCT CASE WHEN {q.has('src')} THEN src END) AS unique_strings, "
    f"CAST(sum({q.count('src')}) AS BIGINT) AS jp_chars_before, CAST(sum({q.count('tgt')}) AS BIGINT) AS jp_chars_after "
    "FROM bilingual GROUP BY deck_id), "
    f"by_slide AS (SELECT deck_id, slide AS part_name, CAST(sum({q.count('src')}) AS BIGINT) AS n_before, "
    f"CAST(sum({q.count('tgt')}) AS BIGINT) AS n_after FROM bilingual GROUP BY ALL)"
)


@query(
    "deck_totals",
    q.using(
        "SELECT deck_id, unique_strings, CAST(ceil(unique_strings / 40) AS BIGINT) AS api_calls, jp_chars_before, jp_chars_after FROM totals",
        _TOTALS,
    ),
)
def deck_totals(spark, sf_dir):
    return decks.deck_totals(w.bilingual(spark, sf_dir))


def audit_records(spark, sf_dir):
    return decks.deck_audit(w.bilingual(spark, sf_dir))


def map_text(column: str):
    """A map as sorted text, to compare across engines."""
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
        ),
        ";",
    )


@query(
    "deck_audit",
    q.using(
        "SELECT deck_id, page, unique_strings, CAST(ceil(unique_strings / 40) AS BIGINT) AS api_calls, jp_chars_before, jp_chars_after, before, after "
        "FROM (SELECT deck_id, CAST(regexp_extract(part_name, '(\\d+)\\.xml$', 1) AS BIGINT) // 1000 AS page, "
        "string_agg(part_name || '=' || n_before, ';' ORDER BY part_name) AS before, "
        "string_agg(part_name || '=' || n_after, ';' ORDER BY part_name) AS after FROM by_slide GROUP BY ALL) JOIN totals USING (deck_id)",
        _TOTALS,
    ),
)
def deck_audit(spark, sf_dir):
    return audit_records(spark, sf_dir).select(
        "deck_id", "page", "unique_strings", "api_calls", "jp_chars_before", "jp_chars_after",
        map_text("per_slide_before").alias("before"), map_text("per_slide_after").alias("after"),
    )
