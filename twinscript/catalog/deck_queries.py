"""Deck markup, files in and out."""

import io
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from twinscript.catalog import audit_queries
from twinscript.catalog import sql as q
from twinscript.catalog import workloads as w
from twinscript.catalog.registry import query
from twinscript.operators import audits, decks, matching, residual
from twinscript.session import scratch_path
from twinscript.sources import decks as deck_source
from twinscript.sources import files

_CLEAN = r"regexp_replace(text, '[\x00-\x09\x0b-\x1f]', ' ', 'g')"
_LINES = (
    "slide_lines AS (SELECT deck_id, part_kind, part_name, part_no, unnest(ls) AS text, unnest(range(len(ls))) AS para_idx "
    f"FROM (SELECT *, string_split({_CLEAN}, chr(10)) AS ls FROM documents_as_parts))"
)


DECKS_PER_BUNDLE, BUNDLE_BYTES = 500, 8 * 2**20


def _deck_file(doc_id: int, xml: str) -> bytes:
    """A deck of one slide and one notes part; one file in ten is cut short."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("ppt/slides/slide7.xml", xml)
        archive.writestr("ppt/notesSlides/notesSlide7.xml", "<n/>")
        archive.writestr("ppt/theme/theme1.xml", "<t/>")
    data = out.getvalue()
    return data[: len(data) // 2] if doc_id % 10 == 3 else data


def _bundles(decks: Iterable[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    held, size = [], 0
    for deck in decks:
        held.append(deck)
        size += len(deck[1])
        if len(held) >= DECKS_PER_BUNDLE or size >= BUNDLE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _archives(spark, sf_dir) -> str:
    """Each document as a deck file of its own, in bundles; the first deck of a bundle lies beside it. The folder."""
    rows = w.documents(spark, sf_dir)
    clean = F.regexp_replace("text", r"[\x00-\x09\x0b-\x1f]", " ")
    markup = rows.select(F.col("part_no").alias("doc_id"), w.slide_xml(clean).alias("xml"))
    folder = scratch_path(spark, "decks")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        store.create_dir(base)
        task = TaskContext.get().partitionId()
        decks = ((doc_id, _deck_file(doc_id, xml)) for batch in batches for doc_id, xml in zip(batch["doc_id"], batch["xml"]))
        for n, ((first, data), *others) in enumerate(_bundles(decks)):
            # The number before the name keeps equal ids of two tasks apart.
            with store.open_output_stream(f"{base}/{task}-{n}-{first}.pptx") as file:
                file.write(data)
            if others:
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as bundle:
                    for doc_id, deck in others:
                        bundle.writestr(f"{doc_id}.pptx", deck)
                with store.open_output_stream(f"{base}/{task}-{n}.zip") as file:
                    file.write(out.getvalue())
            yield pd.DataFrame({"n": [len(others) + 1]})

    markup.mapInPandas(pack, "n long").write.format("noop").mode("overwrite").save()
    return folder


_MARKUP = (
    "'<p:sld xmlns:a=\"http://schemas.openxmlformats.org/drawingml/2006/main\" xmlns:p=\"http://schemas.openxmlformats.org/presentationml/2006/main\">"
    "<p:sp><p:nvSpPr><p:nvPr><p:ph type=\"title\"/></p:nvPr></p:nvSpPr><a:txBody><a:bodyPr lIns=\"10\"/>' || array_to_string(list_transform("
    "string_split(replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10)), lambda line, i: '<a:p><a:r>' || "
    "CASE WHEN i % 2 = 0 THEN '<a:rPr b=\"1\" sz=\"1800\"><a:latin typeface=\"Arial\"/></a:rPr>' ELSE '<a:rPr sz=\"2400\"/>' END || "
    "'<a:t>' || line || '</a:t></a:r></a:p>'), '') || '</a:txBody></p:sp></p:sld>'"
).format(text=_CLEAN)


@query(
    "read_decks",
    q.using(
        "SELECT CAST(doc_id AS VARCHAR) AS deck, kind AS part_kind, CASE kind WHEN 'slide' THEN 'ppt/slides/slide7.xml' "
        "WHEN 'notes' THEN 'ppt/notesSlides/notesSlide7.xml' END AS part_name, CASE WHEN kind <> 'bad' THEN 7::BIGINT END AS part_no, "
        f"CASE kind WHEN 'slide' THEN md5({_MARKUP}) WHEN 'notes' THEN md5('<n/>') END AS xml_md5, kind = 'bad' AS unreadable "
        "FROM documents CROSS JOIN (VALUES ('slide'), ('notes'), ('bad')) AS k(kind) WHERE (doc_id % 10 = 3) = (kind = 'bad')"
    ).replace("kind AS part_kind", "nullif(kind, 'bad') AS part_kind"),
)
def read_decks(spark, sf_dir):
    """Real files, one in ten of them no archive."""
    rows = deck_source.read_deck_rows(spark, _archives(spark, sf_dir))
    deck = F.regexp_extract("deck_id", r"(\d+)\.pptx$", 1)
    return rows.select(
        deck.alias("deck"), "part_kind", "part_name", "part_no", F.md5(F.encode("xml", "UTF-8")).alias("xml_md5"), F.col("error").isNotNull().alias("unreadable")
    )


@query(
    "extract_paragraphs",
    q.using(f"SELECT deck_id, part_name, para_idx, text FROM slide_lines WHERE {q.nonblank('text')}", _LINES),
)
def extract_paragraphs(spark, sf_dir):
    return deck_source.extract_paragraphs(w.slide_parts(spark, sf_dir)).select("deck_id", "part_name", "para_idx", "text")


@query(
    "extract_tagged_paragraphs",
    q.using(
        "SELECT deck_id, part_name, para_idx, CASE WHEN para_idx % 2 = 1 AND text <> '' THEN '[b]' || text || '[/b]' ELSE text END AS text "
        f"FROM slide_lines WHERE {q.nonblank('text')}",
        _LINES,
    ),
)
def extract_tagged_paragraphs(spark, sf_dir):
    return deck_source.extract_tagged_paragraphs(w.slide_parts(spark, sf_dir)).select(
        "deck_id", "part_name", "para_idx", "text"
    )


@query(
    "extract_text_runs",
    q.using(
        "SELECT deck_id, part_name, 'run' AS record, CASE WHEN para_idx % 2 = 1 THEN 1800 ELSE 2400 END AS font_size, "
        "CASE WHEN para_idx % 2 = 1 THEN 'Arial' END AS font_family, NULL AS margins, count(*) AS n FROM slide_lines GROUP BY ALL "
        "UNION ALL SELECT deck_id, part_name, 'frame', NULL, NULL, 'left=10,right=default,top=default,bottom=default', 1 FROM documents_as_parts",
        _LINES,
    ),
)
def extract_text_runs(spark, sf_dir):
    runs = deck_source.extract_text_runs(w.slide_parts(spark, sf_dir))
    return runs.groupBy("deck_id", "part_name", "record", "font_size", "font_family", "margins").agg(F.count("*").alias("n"))


@query(
    "format_stats",
    q.using(
        "SELECT deck_id, part_name, 1::BIGINT AS text_frames, 1::BIGINT AS title_frames, 0::BIGINT AS body_frames, "
        "CASE WHEN len(ls) > 1 THEN 'Arial' ELSE '' END AS font_families, len(ls) AS n_font_sizes, "
        "'left=10,right=default,top=default,bottom=default' AS margin_settings, 0::BIGINT AS n_line_spacings "
        f"FROM (SELECT *, string_split({_CLEAN}, chr(10)) AS ls FROM documents_as_parts)"
    ),
)
def format_stats(spark, sf_dir):
    stats = decks.format_stats(deck_source.extract_text_runs(w.slide_parts(spark, sf_dir)))
    return stats.select(
        "deck_id", "part_name", "text_frames", "title_frames", "body_frames",
        F.array_join("font_families", ",").alias("font_families"),
        F.size("font_sizes").cast("long").alias("n_font_sizes"),
        F.array_join("margin_settings", "|").alias("margin_settings"),
        F.size("line_spacings").cast("long").alias("n_line_spacings"),
    )


ENTRIES_PER_OBJECT, RECORDS_PER_ARRAY = 250, 100


def _joined(items, size, opening, closing):
    """A column of texts joined by commas, up to ``size`` of them between two marks.

    Blocks are cut by place, so none outgrows that whatever the keys.
    """
    item = F.col(items.columns[0])
    block = F.floor(F.monotonically_increasing_id() / size)
    lines = items.select(block.alias("block"), item.alias("item")).groupBy("block").agg(F.collect_list("item").alias("all"))
    return lines.select(F.concat(F.lit(opening), F.array_join("all", ","), F.lit(closing)).alias("value"))


def _objects(entries):
    """A column of JSON objects joined into objects of up to ``ENTRIES_PER_OBJECT`` of them, as a cache or price file holds.

    They are joined as text, so equal keys all stay.
    """
    value = F.col(entries.columns[0])
    return _joined(entries.select(value.substr(F.lit(2), F.length(value) - 2)), ENTRIES_PER_OBJECT, "{", "}")


@query(
    "read_kv_json",
    "SELECT 'supplier' AS file, s_name AS key, CAST(s_nationkey AS VARCHAR) AS value FROM supplier UNION ALL "
    "SELECT 'supplier', 'key of ' || s_name, CAST(s_suppkey AS VARCHAR) FROM supplier UNION ALL "
    "SELECT 'conversation', role, text FROM conversations UNION ALL SELECT 'conversation', 'length', CAST(length(text) AS VARCHAR) FROM conversations",
)
def read_kv_json(spark, sf_dir):
    """Files of one object each, and a file of one object per line."""
    of = lambda *pairs: F.to_json(F.create_map(*pairs)).alias("value")
    suppliers = w.table(spark, sf_dir, "supplier").select(
        of(F.col("s_name"), F.col("s_nationkey").cast("string"), F.concat(F.lit("key of "), "s_name"), F.col("s_suppkey").cast("string"))
    )
    turns = w.table(spark, sf_dir, "conversations").select(of(F.col("role"), F.col("text"), F.lit("length"), F.length("text").cast("string")))
    one, many = scratch_path(spark, "objects"), scratch_path(spark, "object-lines")
    _objects(suppliers).write.option("maxRecordsPerFile", 1).text(one)
    turns.write.text(many)
    return files.read_kv_json(spark, one).select(F.lit("supplier").alias("file"), "*").unionByName(
        files.read_kv_json(spark, many, lines=True).select(F.lit("conversation").alias("file"), "*")
    )


@query(
    "read_pricing",
    "SELECT 'part:' || p_partkey AS model, 'part' AS provider, p_retailprice AS \"in\", NULL::DOUBLE AS in_cached, p_size / 4 AS out, "
    "NULL::DOUBLE AS cached_write, NULL::DOUBLE AS cached_read, CASE WHEN p_size > 25 THEN p_type ELSE 'o200k_base' END AS tokenizer FROM part UNION ALL "
    "SELECT 'supplier:' || s_suppkey, 'supplier', s_acctbal, NULL, NULL, NULL, NULL, 'o200k_base' FROM supplier",
)
def read_pricing(spark, sf_dir):
    """A file of objects by line, and files of one object each."""
    rates = F.struct(
        F.col("p_retailprice").alias("in"),
        (F.col("p_size") / 4).alias("out"),
        F.when(F.col("p_size") > 25, F.col("p_type")).alias("tokenizer"),
    )
    entries = F.create_map(
        F.concat(F.lit("part:"), "p_partkey"), rates, F.lit("_meta"), F.struct(F.lit(1.0).alias("in"), F.lit(1.0).alias("out"), F.lit("x").alias("tokenizer"))
    )
    one, many = scratch_path(spark, "prices"), scratch_path(spark, "price-lines")
    w.table(spark, sf_dir, "part").select(F.to_json(entries)).write.text(many)
    balance = F.create_map(F.concat(F.lit("supplier:"), "s_suppkey"), F.struct(F.col("s_acctbal").alias("in")))
    _objects(w.table(spark, sf_dir, "supplier").select(F.to_json(balance))).write.option("maxRecordsPerFile", 1).text(one)
    return files.read_pricing(spark, many, lines=True).unionByName(files.read_pricing(spark, one))


_ROWS = q.using("SELECT deck_id, slide, idx, src, tgt, kind FROM bilingual")


@query("read_bilingual_csv", _ROWS)
def read_bilingual_csv(spark, sf_dir):
    """Written with :func:`write_bilingual` and read again."""
    path = scratch_path(spark, "bilingual")
    files.write_bilingual(w.bilingual(spark, sf_dir), path)
    return files.read_bilingual_csv(spark, path).select("deck_id", "slide", "idx", "src", "tgt", "kind")


@query("write_bilingual", q.using("SELECT slide AS slide_xml, CAST(idx AS VARCHAR) AS paragraph_idx, src AS Japanese, tgt AS English, deck_id FROM bilingual"))
def write_bilingual(spark, sf_dir):
    path = scratch_path(spark, "bilingual")
    files.write_bilingual(w.bilingual(spark, sf_dir), path)
    return spark.read.options(**files.CSV).schema("slide_xml string, paragraph_idx string, Japanese string, English string, deck_id string").csv(path)


@query("write_tm", q.using(f"SELECT src, tgt FROM tm WHERE tgt <> src AND NOT {q.has('tgt')}"))
def write_tm(spark, sf_dir):
    """Two versions: the memory, then its cleaned form, which is the one read."""
    from twinscript.operators.memory import scrub_tm

    path = scratch_path(spark, "tm")
    files.write_tm(w.memory(spark, sf_dir), path, "001")
    files.write_tm(scrub_tm(files.read_tm(spark, path, "001")), path, "002")
    return files.read_tm(spark, path)


@query(
    "write_audit",
    q.using(
        "SELECT 'base' AS run_id, deck_id, unique_strings, jp_chars_before, jp_chars_after, before FROM ("
        "SELECT deck_id, CAST(regexp_extract(part_name, '(\\d+)\\.xml$', 1) AS BIGINT) // 1000 AS page, "
        "string_agg(part_name || '=' || n_before, ';' ORDER BY part_name) AS before FROM by_slide GROUP BY ALL) JOIN totals USING (deck_id)",
        audit_queries._TOTALS,
    ),
)
def write_audit(spark, sf_dir):
    folder = scratch_path(spark, "audits")
    files.write_audit(audit_queries.audit_records(spark, sf_dir), f"{folder}/run-base")
    return files.read_run_audit_lines(spark, f"{folder}/run-*", run_rx=r"run-([^/]+)/").select(
        "run_id", "deck_id", "unique_strings", "jp_chars_before", "jp_chars_after",
        audit_queries.map_text("per_slide_before").alias("before"),
    )


@query(
    "read_run_audits",
    q.using("SELECT 'base' AS run_id, deck_id, part_name, n_before, n_after FROM by_slide", audit_queries._TOTALS),
)
def read_run_audits(spark, sf_dir):
    """Files of an array of records each; the reader takes a file of one record, as a run leaves it, as well."""
    folder = scratch_path(spark, "audits")
    records = audit_queries.audit_records(spark, sf_dir).select(F.to_json(F.struct("*")))
    _joined(records, RECORDS_PER_ARRAY, "[", "]").write.option("maxRecordsPerFile", 1).text(f"{folder}/run-base")
    return files.slides_of_audits(files.read_run_audits(spark, f"{folder}/run-*"))


@query(
    "write_issue_report",
    q.using(
        "SELECT category, slide, CAST(idx AS VARCHAR) AS \"index\", issue_type, description, suggested_fix, deck_id FROM issues WHERE category <> 'terminology_issues'",
        *audit_queries._ALL,
    ),
)
def write_issue_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    files.write_issue_report(audits.all_issues(w.bilingual(spark, sf_dir), banned=w.BANNED), path)
    return spark.read.options(**files.CSV).schema(
        "category string, slide string, index string, issue_type string, description string, suggested_fix string, deck_id string"
    ).csv(path)
