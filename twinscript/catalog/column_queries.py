"""Column functions applied to every paragraph."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscript import rules
from twinscript.catalog import sql as q
from twinscript.catalog import workloads as w
from twinscript.catalog.registry import query
from twinscript.functions import casing, length, masking, script, text
from twinscript.operators import lengths

SEG = "deck_id, part_name, para_idx"
ROW = "deck_id, slide, idx"


def _on_segments(name: str, value: Callable[[Column], Column], sql: str) -> None:
    @query(name, q.using(f"SELECT {SEG}, {sql} AS value FROM segments"))
    def run(spark, sf_dir) -> DataFrame:
        return w.segments(spark, sf_dir).select("deck_id", "part_name", "para_idx", value(F.col("text")).alias("value"))


def _on_targets(name: str, value: Callable[[Column, Column, Column], Column], sql: str) -> None:
    @query(name, q.using(f"SELECT {ROW}, {sql} AS value FROM bilingual"))
    def run(spark, sf_dir) -> DataFrame:
        columns = F.col("src"), F.col("tgt"), F.col("kind")
        return w.bilingual(spark, sf_dir).select("deck_id", "slide", "idx", value(*columns).alias("value"))


_on_segments("has_script", script.has_script, q.has("text"))
_on_segments("count_script_chars", script.count_script_chars, q.count("text"))
_on_segments(
    "count_script_chars_cost_class",
    lambda t: script.count_script_chars(t, rules.SCRIPT_COST),
    q.count("text", q.COST),
)
_on_segments("count_core_script", script.count_core_script, q.core_count("text"))
_on_segments("extract_script_chars", script.extract_script_chars, q.script_chars("text"))
_on_segments("collapse_whitespace", text.collapse_whitespace, q.collapse("text"))
_on_segments("normalize_punctuation", text.normalize_punctuation, q.normalize_punctuation("text"))
_on_segments("normalize_mechanics", text.normalize_mechanics, q.normalize_mechanics("text"))
_on_segments("classify_segment_kind", text.classify_segment_kind, q.kind("text"))
_on_segments(
    "classify_kind_by_length",
    text.classify_kind_by_length,
    f"CASE WHEN {q.n_words('text')} <= 12 THEN 'title' ELSE 'bullet' END",
)
_on_segments("bullet_fragment", text.bullet_fragment, q.bullet_fragment("text"))
_on_segments("title_case", casing.title_case, q.title_case("text"))
_on_targets("strip_tags", lambda src, tgt, kind: text.strip_tags(tgt), q.untag("tgt"))
_on_targets("preview", lambda src, tgt, kind: text.preview(tgt), q.preview("tgt"))
_on_targets("title_case_tagged", lambda src, tgt, kind: casing.title_case_tagged(tgt), q.title_case_tagged("tgt"))
_on_targets("replace_banned", lambda src, tgt, kind: casing.replace_banned(tgt, w.BANNED), q.replace_banned("tgt"))
_on_targets("expansion_ratio", lambda src, tgt, kind: length.expansion_ratio(src, tgt), q.ratio("src", "tgt"))
_on_targets("length_threshold", lambda src, tgt, kind: length.length_threshold(kind), q.threshold("kind"))
_on_targets("is_identity_entry", lambda src, tgt, kind: script.is_identity_entry(src, tgt), "src = tgt")
_on_targets(
    "is_unusable_entry", lambda src, tgt, kind: script.is_unusable_entry(src, tgt), f"src = tgt OR {q.has('tgt')}"
)


@query(
    "filter_nonblank",
    "SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) "
    f"WHERE {q.nonblank('line')} GROUP BY doc_id",
)
def filter_nonblank(spark, sf_dir):
    return w.segments(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


_STYLED = q.replace_banned("norm")


@query(
    "normalize_block",
    q.using(
        f"SELECT {ROW}, {q.collapse('styled')} AS value FROM ("
        f"SELECT *, CASE kind2 WHEN 'title' THEN {q.title_case_tagged('calm')} ELSE {q.bullet_fragment('calm')} END AS styled "
        f"FROM (SELECT *, {_STYLED} AS calm FROM ("
        f"SELECT *, {q.kind('tgt')} AS kind2, {q.normalize_punctuation('tgt')} AS norm FROM bilingual)))"
    ),
)
def normalize_block(spark, sf_dir):
    value = casing.normalize_block(F.col("tgt"), banned=w.BANNED)
    return w.bilingual(spark, sf_dir).select("deck_id", "slide", "idx", value.alias("value"))


@query(
    "normalize_batch",
    q.using(
        f"SELECT {SEG}, CASE kind WHEN 'title' THEN norm ELSE {q.bullet_fragment('norm', '.;:。；：')} END AS value FROM ("
        f"SELECT *, {q.kind('text')} AS kind, {q.normalize_mechanics('text')} AS norm FROM segments)"
    ),
)
def normalize_batch(spark, sf_dir):
    return w.segments(spark, sf_dir).select(
        "deck_id", "part_name", "para_idx", casing.normalize_batch(F.col("text")).alias("value")
    )


def _fragile(spark, sf_dir) -> DataFrame:
    """Targets with a link, a mail address, a code and numbers appended."""
    i = F.col("idx").cast("string")
    return w.bilingual(spark, sf_dir).select(
        "deck_id",
        "slide",
        "idx",
        F.concat("tgt", F.lit(" https://ex.org/"), i, F.lit(" AB"), i, F.lit("-X me@ex.org 3,5% (12) 7")).alias("text"),
    )


def _sql_stage(t: str, tag: str, marked: str) -> str:
    """Number the spans that ``marked`` puts between two unit separators."""
    return (
        f"array_to_string(list_transform(string_split({marked}, chr(31)), lambda p, k: CASE WHEN k % 2 = 0 "
        f"THEN '⟦{tag}_' || (k // 2) || '⟧' ELSE p END), '')"
    )


_URL = rf"regexp_replace(text, '(https?://[^{q.WS}]+|[{q.WORD}][{q.WORD}.%-]*@[{q.WORD}.-]+\.[A-Za-z]{{2,}})', chr(31) || '\1' || chr(31), 'g')"
_NUM = rf"regexp_replace(m1, '(^|[^{q.WORD}])(\p{{Nd}}[\p{{Nd}},.\-–%]*)', '\1' || chr(31) || '\2' || chr(31), 'g')"
_CODE = rf"regexp_replace(m2, '(^|[^{q.WORD}⟦])([A-Z]{{2,}}[A-Z0-9\-_.]*[0-9]+(?:[A-Z0-9\-_.]*[A-Z0-9_])?)', '\1' || chr(31) || '\2' || chr(31), 'g')"
_FRAGILE = f"fragile AS (SELECT {ROW}, tgt || ' https://ex.org/' || idx || ' AB' || idx || '-X me@ex.org 3,5% (12) 7' AS text FROM bilingual)"


@query(
    "mask_fragile",
    q.using(
        f"SELECT {ROW}, {_sql_stage('m2', 'CODE', _CODE)} AS masked FROM ("
        f"SELECT *, {_sql_stage('m1', 'NUM', _NUM)} AS m2 FROM (SELECT *, {_sql_stage('text', 'URL', _URL)} AS m1 FROM fragile))",
        _FRAGILE,
    ),
)
def mask_fragile(spark, sf_dir):
    return _fragile(spark, sf_dir).select(
        "deck_id", "slide", "idx", masking.mask_fragile(F.col("text"))["masked"].alias("masked")
    )


@query("unmask_fragile", q.using(f"SELECT {ROW}, text AS restored FROM fragile", _FRAGILE))
def unmask_fragile(spark, sf_dir):
    m = masking.mask_fragile(F.col("text"))
    return (
        _fragile(spark, sf_dir)
        .withColumn("m", m)
        .select("deck_id", "slide", "idx", masking.unmask_fragile(F.col("m.masked"), F.col("m.marks")).alias("restored"))
    )


@query(
    "mask_round_trip_check",
    q.using(f"SELECT {ROW}, true AS same_text, false AS same_placeholders FROM fragile WHERE starts_with(text, '[')", _FRAGILE),
)
def mask_round_trip_check(spark, sf_dir):
    """The translation of tagged rows loses its code."""
    def translated(masked: Column) -> Column:
        lost = F.replace(masked, F.lit("⟦CODE_1⟧"), F.lit(""))
        return F.when(F.col("text").startswith("["), lost).otherwise(masked)

    return lengths.mask_round_trip_check(_fragile(spark, sf_dir), translated).select(
        "deck_id", "slide", "idx", "same_text", "same_placeholders"
    )


_KINDED = (
    "CASE WHEN kind = 'bullet' AND starts_with(tgt, '•') THEN 'table' WHEN kind = 'bullet' AND starts_with(tgt, '[') "
    "THEN 'body' ELSE kind END"
)


def _spill_kind() -> Column:
    """Four kinds, so that every branch is taken."""
    bullet = F.col("kind") == "bullet"
    return (
        F.when(bullet & F.col("tgt").startswith("•"), "table")
        .when(bullet & F.col("tgt").startswith("["), "body")
        .otherwise(F.col("kind"))
    )


def spill_sql(t: str, k: str) -> tuple[str, str]:
    """(stub, notes) of a text given as a column name."""
    ws = q.words(t)
    n = f"len({ws})"
    sentences = f"string_split(regexp_replace({t}, '([.!?;])[{q.WS}]+', '\\1' || chr(31), 'g'), chr(31))"
    clauses = f"string_split_regex({t}, '[{q.WS}]*(?:,[{q.WS}]*(?:and|but|or)|;[{q.WS}]*)[{q.WS}]*')"
    join = lambda a, lo, hi: f"array_to_string(({a})[{lo}:{hi}], ' ')"
    fallback = (
        f"CASE WHEN {n} > 8 THEN {join(ws, 1, 6)} || ' (→Notes)' ELSE {t} END",
        f"CASE WHEN {n} > 8 THEN 'Complete text: ' || {t} ELSE '' END",
    )
    title = (
        f"regexp_extract({q.collapse(t)} || ' ', '^(.{{0,74}}) ', 1) || '...'",
        f"'Full title: ' || {t}",
    )
    half = f"{n} // 2"
    stub = (
        f"CASE WHEN {k} = 'title' AND length({t}) > 80 THEN {title[0]} "
        f"WHEN {k} = 'bullet' THEN CASE WHEN len({sentences}) > 1 THEN ({sentences})[1] || ' (detail → Notes)' "
        f"WHEN len({clauses}) > 1 THEN ({clauses})[1] || ' (detail → Notes)' "
        f"ELSE {join(ws, 1, half)} || ' (more → Notes)' END "
        f"WHEN {k} = 'table' THEN CASE WHEN {n} > 5 THEN {join(ws, 1, 3)} || '... (Notes)' ELSE {t} END "
        f"ELSE {fallback[0]} END"
    )
    notes = (
        f"CASE WHEN {k} = 'title' AND length({t}) > 80 THEN {title[1]} "
        f"WHEN {k} = 'bullet' THEN CASE WHEN len({sentences}) > 1 THEN 'Additional details: ' || {join(sentences, 2, '')} "
        f"WHEN len({clauses}) > 1 THEN 'Additional details: ' || {join(clauses, 2, '')} "
        f"ELSE 'Continued: ' || {join(ws, f'({half}) + 1', '')} END "
        f"WHEN {k} = 'table' THEN CASE WHEN {n} > 5 THEN 'Full content: ' || {t} ELSE '' END "
        f"ELSE {fallback[1]} END"
    )
    return stub, notes


_STUB, _NOTES = spill_sql("tgt", "k")


@query(
    "spill_to_notes",
    q.using(f"SELECT {ROW}, {_STUB} AS stub, {_NOTES} AS notes FROM (SELECT *, {_KINDED} AS k FROM bilingual)"),
)
def spill_to_notes(spark, sf_dir):
    return (
        w.bilingual(spark, sf_dir)
        .withColumn("s", length.spill_to_notes(F.col("tgt"), _spill_kind()))
        .select("deck_id", "slide", "idx", "s.stub", "s.notes")
    )


_LAST = f"string_split(regexp_replace(tgt, '([.!?])[{q.WS}]+', '\\1' || chr(31), 'g'), chr(31))"


@query(
    "spill_last_sentence",
    q.using(
        f"SELECT {ROW}, CASE WHEN len({_LAST}) > 1 THEN array_to_string(({_LAST})[1:-2], ' ') || ' (details → Notes)' ELSE tgt END AS stub, "
        f"CASE WHEN len({_LAST}) > 1 THEN 'Additional details:' || chr(10) || ({_LAST})[-1] || chr(10) ELSE '' END AS notes FROM bilingual"
    ),
)
def spill_last_sentence(spark, sf_dir):
    return (
        w.bilingual(spark, sf_dir)
        .withColumn("s", length.spill_last_sentence(F.col("tgt")))
        .select("deck_id", "slide", "idx", "s.stub", "s.notes")
    )


_OVER = f"{q.ratio('src', 'tgt')} > {q.threshold('kind')}"


@query(
    "flag_expansion",
    q.using(
        f"SELECT {ROW}, kind, {q.ratio('src', 'tgt')} AS ratio, {_OVER} AS over, "
        f"NOT ({_OVER}) AND {q.ratio('src', 'tgt')} > {q.threshold('kind')} * 0.8::DOUBLE AS borderline FROM bilingual"
    ),
)
def flag_expansion(spark, sf_dir):
    return lengths.flag_expansion(w.bilingual(spark, sf_dir)).select(
        "deck_id", "slide", "idx", "kind", "ratio", "over", "borderline"
    )


def _split_rows(spark, sf_dir) -> DataFrame:
    return w.bilingual(spark, sf_dir).withColumn("s", length.spill_to_notes(F.col("tgt"), F.col("kind"))).select(
        "deck_id", "slide", "idx", "src", "s.stub", "s.notes"
    )


_NUMBER = r"\p{Nd}+(?:[,.]?\p{Nd}+)*[%％]?"
_LINK = rf"https?://[^{q.WS}]+|www\.[^{q.WS}]+"
_STUB2, _NOTES2 = spill_sql("tgt", "kind")


def same_counts(a: str, b: str) -> str:
    return " AND ".join(
        f"len(regexp_extract_all({a}, '{p}')) = len(regexp_extract_all({b}, '{p}'))" for p in (_NUMBER, _LINK)
    )


TERMS_KEPT = "NOT EXISTS (SELECT 1 FROM glossary g WHERE contains(src, g.term) AND NOT contains(whole, g.expected))"


_INTACT = q.using(
    f"SELECT {ROW}, ({same_counts('src', 'whole')}) AND {TERMS_KEPT} AS intact "
    f"FROM (SELECT *, ({_STUB2}) || ' ' || ({_NOTES2}) AS whole FROM bilingual)"
)


@query("content_integrity_merge_join", _INTACT)
def content_integrity_merge_join(spark, sf_dir):
    """The way of a glossary beyond any broadcast."""
    rows = lengths.content_integrity(_split_rows(spark, sf_dir), w.glossary(spark), ["deck_id", "slide", "idx"], inline=0, broadcast=0)
    return rows.select("deck_id", "slide", "idx", "intact")


@query("content_integrity", _INTACT)
def content_integrity(spark, sf_dir):
    rows = lengths.content_integrity(_split_rows(spark, sf_dir), w.glossary(spark), ["deck_id", "slide", "idx"])
    return rows.select("deck_id", "slide", "idx", "intact")


_STUB3, _SPILL3 = spill_sql("condensed", "kind")


@query(
    "length_policy",
    q.using(
        f"SELECT {ROW}, action, "
        "CASE action WHEN 'keep' THEN tgt WHEN 'spill' THEN stub ELSE condensed END AS text, "
        "CASE action WHEN 'spill' THEN spill ELSE '' END AS notes, "
        "CASE action WHEN 'keep' THEN r1 > th * 0.8::DOUBLE WHEN 'condense' THEN r2 > th * 0.85::DOUBLE "
        f"WHEN 'spill' THEN {q.ratio('src', 'stub')} > th * 0.9::DOUBLE ELSE true END AS needs_tightening FROM ("
        "SELECT *, CASE WHEN r1 <= th THEN 'keep' WHEN r2 <= th THEN 'condense' "
        f"WHEN ({same_counts('src', 'whole')}) AND {TERMS_KEPT} THEN 'spill' ELSE 'condense_unspilled' END AS action FROM ("
        "SELECT *, stub || ' ' || spill AS whole FROM ("
        f"SELECT *, {q.ratio('src', 'tgt')} AS r1, {q.ratio('src', 'condensed')} AS r2, {q.threshold('kind')} AS th, "
        f"{_STUB3} AS stub, {_SPILL3} AS spill FROM (SELECT *, replace(tgt, ' the ', ' ') AS condensed FROM bilingual))))"
    ),
)
def length_policy(spark, sf_dir):
    rows = w.bilingual(spark, sf_dir).withColumn("condensed", F.replace("tgt", F.lit(" the "), F.lit(" ")))
    return lengths.length_policy(rows, w.glossary(spark), ["deck_id", "slide", "idx"]).select(
        "deck_id", "slide", "idx", "action", "text", "notes", "needs_tightening"
    )


@query(
    "spilled_notes_by_slide",
    q.using(
        "SELECT deck_id, slide AS part_name, string_agg(notes, chr(10) || chr(10) ORDER BY idx) AS notes FROM ("
        f"SELECT *, {_NOTES2} AS notes FROM bilingual) WHERE {q.nonblank('notes')} GROUP BY deck_id, slide"
    ),
)
def spilled_notes_by_slide(spark, sf_dir):
    rows = w.bilingual(spark, sf_dir)
    spilled = (
        rows.select("tgt", length.spill_to_notes(F.col("tgt"), F.col("kind"))["notes"].alias("notes"))
        .groupBy(F.col("tgt").alias("src"))
        .agg(F.max("notes").alias("notes"))
    )
    return lengths.spilled_notes_by_slide(w.target_segments(spark, sf_dir), spilled)
