"""Rule tables against texts, bullet groups, diagnostics."""

from pyspark.sql import functions as F

from twinscript.catalog import sql as q
from twinscript.catalog import workloads as w
from twinscript.catalog.registry import query
from twinscript.operators import audits, diagnostics, islands, matching

ROW = ["deck_id", "slide", "idx"]
_ROW = "deck_id, slide, idx"
MERGED = {"inline": 0, "broadcast": 0}  # the way of rule tables beyond any broadcast


def _rules(spark):
    return (
        matching.dict_table(spark, w.BANNED, "phrase", "suggested"),
        matching.dict_table(spark, w.MARKS, "original", "correct"),
        w.glossary(spark),
        matching.alternatives_table(spark, w.ALTERNATIVES),
    )


_HITS = q.using(f"SELECT {_ROW}, term, expected FROM bilingual JOIN glossary ON contains(src, term)")


@query("glossary_hits", _HITS)
def glossary_hits(spark, sf_dir):
    return matching.glossary_hits(w.bilingual(spark, sf_dir), w.glossary(spark)).select(*ROW, "term", "expected")


@query("glossary_hits_large_table", _HITS)
def glossary_hits_large_table(spark, sf_dir):
    """The way taken when the glossary is too large to inline."""
    return matching.glossary_hits(w.bilingual(spark, sf_dir), w.glossary(spark), inline=0).select(*ROW, "term", "expected")


@query("glossary_hits_merge_join", _HITS)
def glossary_hits_merge_join(spark, sf_dir):
    """The way taken when the glossary is too large to broadcast."""
    return matching.glossary_hits(w.bilingual(spark, sf_dir), w.glossary(spark), **MERGED).select(*ROW, "term", "expected")


@query(
    "glossary_missing",
    q.using(f"SELECT {_ROW}, term, expected FROM bilingual JOIN glossary ON contains(src, term) AND NOT contains(tgt, expected)"),
)
def glossary_missing(spark, sf_dir):
    return matching.glossary_missing(w.bilingual(spark, sf_dir), w.glossary(spark)).select(*ROW, "term", "expected")


_BARE = f"bare AS (SELECT *, lower({q.untag('tgt')}) AS b FROM bilingual)"
_ALT = q.using(
    f"SELECT {_ROW}, term, expected, first(alt ORDER BY place) AS found, left(tgt, 50) || '...' AS context "
    "FROM bare JOIN glossary ON NOT contains(b, lower(expected)) JOIN alternatives USING (term) "
    f"WHERE contains(b, lower(alt)) GROUP BY {_ROW}, term, expected, tgt",
    _BARE,
)


@query("glossary_alternatives", _ALT)
def glossary_alternatives(spark, sf_dir):
    _, _, terms, alts = _rules(spark)
    return matching.glossary_alternatives(w.bilingual(spark, sf_dir), terms, alts, ROW)


@query("glossary_alternatives_large_table", _ALT)
def glossary_alternatives_large_table(spark, sf_dir):
    _, _, terms, alts = _rules(spark)
    return matching.glossary_alternatives(w.bilingual(spark, sf_dir), terms, alts, ROW, inline=0)


@query("glossary_alternatives_merge_join", _ALT)
def glossary_alternatives_merge_join(spark, sf_dir):
    _, _, terms, alts = _rules(spark)
    return matching.glossary_alternatives(w.bilingual(spark, sf_dir), terms, alts, ROW, **MERGED)


@query(
    "term_usage",
    q.using(f"SELECT {_ROW}, term, expected AS usage, b AS context FROM bare JOIN glossary ON contains(b, lower(expected))", _BARE),
)
def term_usage(spark, sf_dir):
    return matching.term_usage(w.bilingual(spark, sf_dir), w.glossary(spark))


_USES = (
    f"uses AS (SELECT {_ROW}, term, variant FROM bare JOIN (SELECT term, expected AS variant FROM glossary UNION "
    "SELECT term, alt FROM glossary JOIN alternatives USING (term)) ON contains(b, lower(variant)))"
)
_VARIANTS = (
    "variants AS (SELECT * FROM (SELECT deck_id, term, variant, count(*) OVER (PARTITION BY deck_id, term) AS n_variants, "
    "count(*) AS n_uses, first(slide ORDER BY slide, idx) AS first_slide, first(idx ORDER BY slide, idx) AS first_idx "
    "FROM uses GROUP BY deck_id, term, variant) WHERE n_variants > 1)"
)


def _uses(spark, sf_dir):
    _, _, terms, alts = _rules(spark)
    return matching.term_variant_uses(w.bilingual(spark, sf_dir), terms, alts)


@query("term_variants", q.using("SELECT * FROM variants", _BARE, _USES, _VARIANTS))
def term_variants(spark, sf_dir):
    return matching.term_variants(_uses(spark, sf_dir))


@query(
    "term_variant_places",
    q.using(
        f"SELECT {_ROW}, term, variant, n_variants FROM uses JOIN variants USING (deck_id, term, variant)",
        _BARE, _USES, _VARIANTS,
    ),
)
def term_variant_places(spark, sf_dir):
    return matching.term_variant_places(_uses(spark, sf_dir)).select(*ROW, "term", "variant", "n_variants")


def _flagged(rows: str, text: str) -> str:
    """Rows joined to each phrase that stands in ``text``."""
    return " UNION ALL ".join(
        f"SELECT r.*, {q.quote(phrase)} AS phrase, {q.quote(wanted)} AS suggested, {place} AS place FROM ({rows}) r "
        f"WHERE {q.has_phrase(text, phrase)}"
        for place, (phrase, wanted) in enumerate(w.BANNED.items())
    )


_FLAGS = q.using(
    f"SELECT {_ROW}, phrase, suggested, left(t, 80) || '...' AS context FROM "
    f"({_flagged('SELECT *, ' + q.untag('tgt') + ' AS t FROM bilingual', 't')})"
)


@query("banned_phrase_flags", _FLAGS)
def banned_phrase_flags(spark, sf_dir):
    banned = _rules(spark)[0]
    return matching.banned_phrase_flags(w.bilingual(spark, sf_dir), banned, "tgt").select(
        *ROW, "phrase", "suggested", "context"
    )


@query("banned_phrase_flags_large_table", _FLAGS)
def banned_phrase_flags_large_table(spark, sf_dir):
    banned = _rules(spark)[0]
    return matching.banned_phrase_flags(w.bilingual(spark, sf_dir), banned, "tgt", inline=0).select(
        *ROW, "phrase", "suggested", "context"
    )


_MATCHES = q.using(
    f"SELECT {_ROW}, word, coalesce(suggested, 'review') AS suggested, {q.preview('t', 60)} AS context FROM ("
    f"SELECT *, unnest({q.phrase_matches('t')}) AS word FROM (SELECT *, {q.untag('tgt')} AS t FROM bilingual)) "
    "LEFT JOIN banned ON phrase = lower(word)"
)


@query("banned_word_matches", _MATCHES)
def banned_word_matches(spark, sf_dir):
    return matching.banned_word_matches(w.bilingual(spark, sf_dir), _rules(spark)[0])


@query("banned_word_matches_large_table", _MATCHES)
def banned_word_matches_large_table(spark, sf_dir):
    return matching.banned_word_matches(w.bilingual(spark, sf_dir), _rules(spark)[0], inline=0)


@query("banned_word_matches_merge_join", _MATCHES)
def banned_word_matches_merge_join(spark, sf_dir):
    return matching.banned_word_matches(w.bilingual(spark, sf_dir), _rules(spark)[0], **MERGED)


@query(
    "punct_flags",
    q.using(
        f"SELECT deck_id, part_name, para_idx, original, correct, left(text, 50) || '...' AS context "
        "FROM segments JOIN marks ON contains(text, original)"
    ),
)
def punct_flags(spark, sf_dir):
    return matching.punct_flags(w.segments(spark, sf_dir), _rules(spark)[1]).select(
        "deck_id", "part_name", "para_idx", "original", "correct", "context"
    )


def _groups_sql(key: str, source: str) -> str:
    """Islands of bullet-like rows: ``source`` has key, pos order columns and text."""
    return (
        f"ordered AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY o1, o2) AS pos FROM ({source})), "
        f"flagged AS (SELECT *, contains(text, '[li-') OR contains(text, '•') OR ({q.n_words('text')} < 15 AND NOT ends_with(text, '.')) AS bullet, "
        f"regexp_matches({q.strip(q.untag('text'))}, '^[{q.WORD}]+ing($|[^{q.WORD}])') AS gerund FROM ordered), "
        f"ran AS (SELECT *, sum(CASE WHEN bullet THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY pos) AS breaks FROM flagged), "
        f"groups AS (SELECT {key}, CAST(breaks AS BIGINT) AS group_id, min(pos) - 1 AS first_index, max(pos) - 1 AS last_index, count(*) AS n_items, "
        f"count(*) FILTER (gerund) AS n_gerund FROM ran WHERE bullet GROUP BY {key}, breaks HAVING count(*) >= 2)"
    )


# Lines that end in a full stop get an -ing word in front, so that forms differ.
_DECK_GROUPS = _groups_sql(
    "deck_id",
    "SELECT deck_id, slide AS o1, idx AS o2, CASE WHEN ends_with(tgt, '.') THEN 'Going • ' || tgt ELSE tgt END AS text FROM bilingual",
)


def _bullets(spark, sf_dir):
    text = F.col("text")
    return w.target_segments(spark, sf_dir).withColumn(
        "text", F.when(text.endswith("."), F.concat(F.lit("Going • "), text)).otherwise(text)
    )


@query("bullet_groups", q.using("SELECT * FROM groups", _DECK_GROUPS))
def bullet_groups(spark, sf_dir):
    return islands.bullet_groups(_bullets(spark, sf_dir))


@query(
    "parallelism_issues",
    q.using(
        "SELECT *, 'Mix of gerunds (' || n_gerund || ') and other forms in bullet group' AS note FROM groups "
        "WHERE n_items >= 3 AND n_gerund > 0 AND n_gerund < n_items",
        _DECK_GROUPS,
    ),
)
def parallelism_issues(spark, sf_dir):
    return islands.parallelism_issues(islands.bullet_groups(_bullets(spark, sf_dir)))


_TITLE_FIX = f"SELECT batch_id, \"index\", text, {q.title_case_tagged('text')} AS fix FROM checked WHERE {q.kind('text')} = 'title'"
_BARE_TEXT = q.strip(q.untag("text"))
_BULLET_FIX = (
    f"SELECT batch_id, \"index\", text, {q.rstrip(f'''regexp_replace({q.rstrip('text')}, '[.:;]$', '')''')} AS fix FROM checked "
    f"WHERE (contains(text, '[li-') OR contains(text, '•') OR ({q.n_words(_BARE_TEXT)} < 15 AND len(regexp_extract_all({_BARE_TEXT}, '\\.')) <= 1)) "
    f"AND regexp_matches({_BARE_TEXT}, '[.:;]$') AND {q.marks(_BARE_TEXT)} <= 1"
)
_FINDINGS = (
    f"title_fix AS (SELECT * FROM ({_TITLE_FIX}) WHERE fix <> text), bullet_fix AS ({_BULLET_FIX}), "
    "findings AS ("
    "SELECT batch_id, \"index\", 'title_case_violations' AS category, 0 AS stage, 0 AS place, NULL AS find, fix AS replacement FROM title_fix UNION ALL "
    "SELECT batch_id, \"index\", 'bullet_terminal_punctuation', 1, 0, NULL, fix FROM bullet_fix UNION ALL "
    f"SELECT batch_id, \"index\", 'banned_phrases', 2, place, phrase, suggested FROM ({_flagged('SELECT * FROM checked', q.untag('text'))}) UNION ALL "
    "SELECT batch_id, \"index\", 'punctuation_errors', 3, place, original, correct FROM checked JOIN marks ON contains(text, original) UNION ALL "
    "SELECT batch_id, \"index\", 'glossary_violations', 4, 0, first(alt ORDER BY place), expected FROM ("
    f"SELECT *, lower({q.untag('text')}) AS b FROM checked) JOIN glossary ON NOT contains(b, lower(expected)) JOIN alternatives USING (term) "
    "WHERE contains(b, lower(alt)) GROUP BY batch_id, \"index\", term, expected)"
)


def _check_columns(df):
    return df.select("batch_id", "index", "text", F.col("suggested_fix").alias("fix"))


@query("check_title_case", q.using("SELECT * FROM title_fix", _FINDINGS))
def check_title_case(spark, sf_dir):
    return _check_columns(audits.check_title_case(w.checked_segments(spark, sf_dir), ["batch_id", "index"]))


@query("check_bullet_punct", q.using("SELECT * FROM bullet_fix", _FINDINGS))
def check_bullet_punct(spark, sf_dir):
    return _check_columns(audits.check_bullet_punct(w.checked_segments(spark, sf_dir), ["batch_id", "index"]))


@query("style_diagnostics", q.using("SELECT * FROM findings", _FINDINGS))
def style_diagnostics(spark, sf_dir):
    return diagnostics.style_diagnostics(w.checked_segments(spark, sf_dir), *_rules(spark))


@query("style_diagnostics_large_tables", q.using("SELECT * FROM findings", _FINDINGS))
def style_diagnostics_large_tables(spark, sf_dir):
    return diagnostics.style_diagnostics(w.checked_segments(spark, sf_dir), *_rules(spark), inline=0)


def _replies(spark, sf_dir):
    """Each slide's title and bullet findings as the JSON a reviewer sends."""
    rows = w.checked_segments(spark, sf_dir)
    titles = audits.check_title_case(rows, ["batch_id", "index"]).withColumn("category", F.lit("t"))
    bullets = audits.check_bullet_punct(rows, ["batch_id", "index"]).withColumn("category", F.lit("b"))
    item = F.struct(F.col("index"), F.col("text"), F.lit("x").alias("issue"), F.col("suggested_fix"))
    both = titles.unionByName(bullets).groupBy("batch_id").agg(
        F.array_compact(F.collect_list(F.when(F.col("category") == "t", item))).alias("title_case_violations"),
        F.array_compact(F.collect_list(F.when(F.col("category") == "b", item))).alias("bullet_terminal_punctuation"),
    )
    style = F.struct("title_case_violations", "bullet_terminal_punctuation")
    return both.select("batch_id", F.to_json(F.struct(style.alias("style"))).alias("reply"))


@query(
    "parse_diagnostics",
    q.using("SELECT batch_id, \"index\", category, stage, find, replacement FROM findings WHERE stage <= 1", _FINDINGS),
)
def parse_diagnostics(spark, sf_dir):
    return diagnostics.parse_diagnostics(_replies(spark, sf_dir)).drop("place")


def _fixed_sql() -> str:
    t = "coalesce(b.fix, t.fix, c.text)"
    found = {phrase: q.has_phrase(q.untag("text"), phrase) for phrase in w.BANNED}
    steps = [(f"SELECT c.batch_id, c.\"index\", c.text, {t} AS s FROM checked c LEFT JOIN title_fix t USING (batch_id, \"index\") "
              "LEFT JOIN bullet_fix b USING (batch_id, \"index\")")]
    for phrase, wanted in w.BANNED.items():
        steps.append(f"CASE WHEN {found[phrase]} THEN {q.replace_phrase('s', phrase, wanted)} ELSE s END")
    for mark, wanted in w.MARKS.items():
        steps.append(f"CASE WHEN contains(text, {q.quote(mark)}) THEN replace(s, {q.quote(mark)}, {q.quote(wanted)}) ELSE s END")
    expected = dict(w.GLOSSARY)
    bare = f"lower({q.untag('text')})"
    # Findings of one stage and place apply in the order of what they look for.
    fixes = []
    for term, alts in w.ALTERNATIVES.items():
        for i, alt in enumerate(alts):
            earlier = " AND ".join([f"NOT contains({bare}, '{a}')" for a in alts[:i]] + ["true"])
            fixes.append((alt, expected[term], f"contains({bare}, '{alt}') AND {earlier} AND NOT contains({bare}, '{expected[term].lower()}')"))
    for alt, want, condition in sorted(fixes):
        steps.append(f"CASE WHEN {condition} THEN {q.replace_phrase('s', alt, want)} ELSE s END")
    sql = steps[0]
    for step in steps[1:]:
        sql = f"SELECT batch_id, \"index\", text, {step} AS s FROM ({sql})"
    return f"SELECT batch_id, \"index\", s AS fixed FROM ({sql})"


@query("apply_diagnostics", q.using(_fixed_sql(), _FINDINGS))
def apply_diagnostics(spark, sf_dir):
    rows = w.checked_segments(spark, sf_dir)
    return diagnostics.apply_diagnostics(rows, diagnostics.style_diagnostics(rows, *_rules(spark))).select(
        "batch_id", "index", "fixed"
    )


@query("check_and_fix", q.using(_fixed_sql(), _FINDINGS))
def check_and_fix(spark, sf_dir):
    """Checks and fixes in one pass, without a join."""
    return diagnostics.check_and_fix(w.checked_segments(spark, sf_dir), *_rules(spark)).select(
        "batch_id", "index", "fixed"
    )


@query(
    "parallelism_findings",
    q.using(
        "SELECT * FROM (SELECT batch_id, first_index, last_index, n_items, n_gerund FROM groups) WHERE n_items >= 3 AND n_gerund > 0 AND n_gerund < n_items",
        _groups_sql("batch_id", "SELECT batch_id, \"index\" AS o1, 0 AS o2, CASE WHEN ends_with(text, '.') THEN 'Going • ' || text ELSE text END AS text FROM checked"),
    ),
)
def parallelism_findings(spark, sf_dir):
    """Lines that end in a full stop get an -ing word in front."""
    text = F.col("text")
    rows = w.checked_segments(spark, sf_dir).withColumn(
        "text", F.when(text.endswith("."), F.concat(F.lit("Going • "), text)).otherwise(text)
    )
    return diagnostics.parallelism_findings(rows).select("batch_id", "first_index", "last_index", "n_items", "n_gerund")
