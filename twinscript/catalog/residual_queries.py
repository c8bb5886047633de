"""Residual characters, worklists and gates."""

from pyspark.sql import functions as F

from twinscript import rules
from twinscript.catalog import sql as q
from twinscript.catalog import workloads as w
from twinscript.catalog.registry import query
from twinscript.operators import residual as r
from twinscript.operators import segments as s
from twinscript.plans import flows
from twinscript.session import scratch_path
from twinscript.sources import files

_BY_SLIDE = f"by_slide AS (SELECT deck_id, part_name, CAST(sum({q.count('text')}) AS BIGINT) AS n_chars FROM segments GROUP BY ALL)"


@query(
    "deck_residual_report",
    q.using(
        "SELECT deck_id, count(*) AS slides, count(*) FILTER (n_chars > 0) AS slides_with_residual, "
        "CAST(sum(n_chars) AS BIGINT) AS total_chars, max(n_chars) AS worst_chars, "
        "last(part_name ORDER BY n_chars, part_name) AS worst_slide "
        f"FROM (SELECT deck_id, part_name, {q.count('text')} AS n_chars FROM parts) GROUP BY deck_id"
    ),
)
def deck_residual_report(spark, sf_dir):
    return r.deck_residual_report(w.parts(spark, sf_dir))


@query("script_chars_by_slide", q.using("SELECT * FROM by_slide", _BY_SLIDE))
def script_chars_by_slide(spark, sf_dir):
    return r.script_chars_by_slide(w.segments(spark, sf_dir))


@query(
    "script_chars_by_slide_strict",
    q.using(f"SELECT deck_id, part_name, CAST(sum({q.core_count('text')}) AS BIGINT) AS n_chars FROM segments GROUP BY ALL"),
)
def script_chars_by_slide_strict(spark, sf_dir):
    return r.script_chars_by_slide(w.segments(spark, sf_dir), strict=True)


@query(
    "script_chars_total",
    q.using(
        "SELECT deck_id, part_name, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(GROUPING(deck_id, part_name) AS INTEGER) AS level "
        "FROM by_slide GROUP BY ROLLUP (deck_id, part_name)",
        _BY_SLIDE,
    ),
)
def script_chars_total(spark, sf_dir):
    return r.script_chars_total(w.segments(spark, sf_dir))


@query(
    "before_after_by_slide",
    q.using(
        "SELECT *, n_after - n_before AS delta FROM (SELECT deck_id, slide AS part_name, "
        f"CAST(sum({q.count('src')}) AS BIGINT) AS n_before, CAST(sum({q.count('tgt')}) AS BIGINT) AS n_after "
        "FROM bilingual GROUP BY ALL)"
    ),
)
def before_after_by_slide(spark, sf_dir):
    return r.before_after_of_pairs(w.bilingual(spark, sf_dir))


@query(
    "before_after_by_slide_of_two_tables",
    q.using(
        "SELECT deck_id, part_name, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after, "
        "coalesce(n_after, 0) - coalesce(n_before, 0) AS delta FROM "
        "(SELECT deck_id, part_name, n_chars AS n_before FROM by_slide) FULL JOIN "
        f"(SELECT deck_id, slide AS part_name, CAST(sum({q.count('tgt')}) AS BIGINT) AS n_after FROM bilingual GROUP BY ALL) "
        "USING (deck_id, part_name)",
        _BY_SLIDE,
    ),
)
def before_after_of_two_tables(spark, sf_dir):
    return r.before_after_by_slide(w.segments(spark, sf_dir), w.target_segments(spark, sf_dir))


@query(
    "residual_summary",
    q.using(
        "SELECT deck_id, CAST(sum(n_chars) AS BIGINT) AS total_chars, "
        "count(*) FILTER (n_chars > 0) AS slides_with_residual, count(*) AS slides FROM by_slide GROUP BY deck_id",
        _BY_SLIDE,
    ),
)
def residual_summary(spark, sf_dir):
    return r.residual_summary(r.script_chars_by_slide(w.segments(spark, sf_dir)))


@query(
    "top_residual_slides",
    q.using("SELECT * FROM by_slide WHERE n_chars > 0 ORDER BY n_chars DESC, deck_id, part_name LIMIT 10", _BY_SLIDE),
)
def top_residual_slides(spark, sf_dir):
    return r.top_residual_slides(r.script_chars_by_slide(w.segments(spark, sf_dir)), 10)


@query(
    "residual_gate",
    q.using(
        "SELECT deck_id, remaining, remaining <= 20000 AS passed, CASE WHEN remaining > 20000 THEN "
        "remaining || ' source characters remain (max 20000)' ELSE remaining || ' source characters remain' END AS reason "
        "FROM (SELECT deck_id, CAST(sum(n_chars) AS BIGINT) AS remaining FROM by_slide GROUP BY deck_id)",
        _BY_SLIDE,
    ),
)
def residual_gate(spark, sf_dir):
    return r.residual_gate(r.script_chars_by_slide(w.segments(spark, sf_dir)), 20000)


@query(
    "residual_worklist",
    q.using(
        "SELECT tgt AS jp_text, '' AS proposed_en, first(deck_id ORDER BY deck_id, slide, idx) AS deck_example, "
        "first(slide ORDER BY deck_id, slide, idx) AS slide_example, count(*) AS n_uses "
        f"FROM bilingual WHERE {q.has('tgt')} GROUP BY tgt"
    ),
)
def residual_worklist(spark, sf_dir):
    return r.residual_worklist(r.residual_locations(w.bilingual(spark, sf_dir)))


def _filled_sql(table: str) -> str:
    """The patch of a worklist over ``table``'s targets: some left empty, some unchanged, the rest filled."""
    proposal = "CASE length(tgt) % 4 WHEN 0 THEN ' ' WHEN 1 THEN tgt ELSE 'Line, \"of\" ' || length(tgt) END"
    return f"patch AS (SELECT DISTINCT tgt AS src, {proposal} AS tgt FROM {table} WHERE {q.has('tgt')} AND length(tgt) % 4 > 1)"


def _filled(spark, pairs):
    """A worklist written, filled by a rule, written and read again."""
    locations = r.residual_locations(pairs)
    size = F.length("jp_text")
    proposal = F.when(size % 4 == 0, " ").when(size % 4 == 1, F.col("jp_text")).otherwise(F.concat(F.lit('Line, "of" '), size))
    path = scratch_path(spark, "worklist")
    files.write_worklist(r.residual_worklist(locations).withColumn("proposed_en", proposal), path)
    return files.read_worklist(spark, path)


@query("residual_patch", q.using("SELECT src, tgt FROM patch", _filled_sql("bilingual")))
def residual_patch(spark, sf_dir):
    return r.residual_patch(_filled(spark, w.bilingual(spark, sf_dir)))


@query(
    "patch_residuals",
    q.using(
        "SELECT deck_id, slide, idx, b.src, coalesce(p.tgt, b.tgt) AS tgt, kind, p.tgt IS NOT NULL AS patched "
        "FROM bilingual b LEFT JOIN patch p ON b.tgt = p.src",
        _filled_sql("bilingual"),
    ),
)
def patch_residuals(spark, sf_dir):
    """Residual texts replaced by what a filled worklist says."""
    rows = w.bilingual(spark, sf_dir)
    return flows.patch_residuals(rows, w.memory(spark, sf_dir), _filled(spark, rows))[0]


@query(
    "patch_memory",
    q.using(
        "SELECT src, coalesce(p.tgt, n.tgt, m.tgt) AS tgt FROM (SELECT src FROM tm UNION SELECT src FROM patch) "
        "LEFT JOIN tm m USING (src) LEFT JOIN patch p USING (src) LEFT JOIN patch n ON m.tgt = n.src",
        _filled_sql("tm"),
    ),
)
def patch_memory(spark, sf_dir):
    """The memory after a worklist of its own residual translations."""
    tm = w.memory(spark, sf_dir)
    pairs = tm.select(F.lit("tm").alias("deck_id"), F.lit("tm").alias("slide"), F.lit(0).cast("long").alias("idx"), "src", "tgt")
    return flows.patch_residuals(pairs, tm, _filled(spark, pairs))[1]


_REPORT = {
    "summary": "SELECT 'summary' AS part, deck_id, CAST(sum(n_chars) AS BIGINT) AS n FROM by_slide GROUP BY deck_id",
    "gate": "SELECT 'failed', deck_id, CAST(sum(n_chars) AS BIGINT) FROM by_slide GROUP BY deck_id HAVING sum(n_chars) > 500",
    "top": "SELECT 'top', deck_id, n_chars FROM (SELECT * FROM by_slide WHERE n_chars > 0 ORDER BY n_chars DESC, deck_id, part_name LIMIT 10)",
}


@query("residual_report", q.using(" UNION ALL ".join(_REPORT.values()), _BY_SLIDE))
def residual_report(spark, sf_dir):
    """The flow's three results in one table."""
    report = flows.residual_report(w.segments(spark, sf_dir), limit=500, k=10)
    of = lambda part, df, n: df.select(F.lit(part).alias("part"), "deck_id", F.col(n).alias("n"))
    failed = report["gate"].filter(~F.col("passed"))
    return of("summary", report["summary"], "total_chars").unionByName(of("failed", failed, "remaining")).unionByName(of("top", report["top"], "n_chars"))


@query(
    "filter_slide_range",
    q.using(
        "SELECT deck_id, part_name, para_idx, text FROM segments "
        "WHERE CAST(regexp_extract(part_name, 'slide(\\d+)', 1) AS BIGINT) BETWEEN 100 AND 700"
    ),
)
def filter_slide_range(spark, sf_dir):
    return s.filter_slide_range(w.segments(spark, sf_dir), "100-700").select("deck_id", "part_name", "para_idx", "text")


@query("order_slides", q.using("SELECT * FROM by_slide ORDER BY deck_id, part_name", _BY_SLIDE))
def order_slides(spark, sf_dir):
    return s.order_slides(r.script_chars_by_slide(w.segments(spark, sf_dir)))


_BLOCKS = (
    "blocks AS (SELECT deck_id, block_idx, text FROM (SELECT CAST(page_id AS VARCHAR) AS deck_id, "
    "unnest(bs) AS text, unnest(range(len(bs))) AS block_idx FROM (SELECT page_id, list_filter(list_transform(string_split_regex("
    "regexp_replace({joined}, '\\r\\n|\\r|\\n', chr(10), 'g'), '\\n{{2,}}'), lambda b: {stripped}), lambda b: b <> '') AS bs FROM pages)))"
)
_JOINED = q.replace_chain(
    "array_to_string(regexp_extract_all(regexp_replace(html, '<br\\s*/?>', chr(10), 'g'), '(?s)<p>(.*?)</p>', 1), '')",
    ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"),
)


@query(
    "extract_text_blocks",
    q.using(
        "SELECT * FROM blocks",
        _BLOCKS.format(joined=_JOINED, stripped=q.strip("b")),
    ),
)
def extract_text_blocks(spark, sf_dir):
    blocks = s.extract_text_blocks(
        w.pages(spark, sf_dir).select("deck_id", "html"), "html", r"(?s)<p>(.*?)</p>", r"<br\s*/?>"
    )
    return blocks.select("deck_id", "block_idx", "text")


def _blocks_of(spark, sf_dir):
    """Documents as slides of their source's deck, conversations as the notes of decks without slides."""
    slides = w.documents(spark, sf_dir).select(
        "deck_id",
        F.col("part_no").cast("string").alias("part_name"),
        F.lit(0).cast("long").alias("block_idx"),
        w.in_kana(F.col("text")).alias("text"),
    )
    notes = w.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("deck_id"),
        F.col("conv_id").cast("string").alias("part_name"),
        F.col("turn").cast("long").alias("block_idx"),
        w.in_kana(F.col("text")).alias("text"),
    )
    return s.union_slide_notes(slides, notes)


_UNION = (
    "blocks AS (SELECT source AS deck_id, CAST(doc_id AS VARCHAR) AS part_name, 0 AS block_idx, "
    f"translate(text, {q._KANA}) AS text, 'slide' AS part_kind FROM documents UNION ALL "
    "SELECT CAST(conv_id AS VARCHAR), CAST(conv_id AS VARCHAR), turn, "
    f"translate(text, {q._KANA}), 'notes' FROM conversations)"
)


@query(
    "union_slide_notes",
    q.using(
        "SELECT deck_id, part_kind, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM blocks GROUP BY ALL",
        _UNION,
    ),
)
def union_slide_notes(spark, sf_dir):
    return (
        _blocks_of(spark, sf_dir)
        .groupBy("deck_id", "part_kind")
        .agg(F.count("*").alias("n_blocks"), F.sum(F.length("text").cast("long")).alias("n_chars"))
    )


@query(
    "sample_first_blocks",
    q.using(
        "SELECT deck_id, count(*) AS n_blocks, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS sample "
        "FROM (SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY part_kind DESC, part_name, block_idx) AS rank "
        f"FROM blocks WHERE {q.has('text', q.COST)}) WHERE rank <= 10 GROUP BY deck_id",
        _UNION,
    ),
)
def sample_first_blocks(spark, sf_dir):
    return s.sample_first_blocks(_blocks_of(spark, sf_dir), rules.SCRIPT_COST, 10)
