import json
import zipfile

import pytest
from pyspark.sql import functions as F

from twinscript.operators import decks as deck_ops
from twinscript.operators.residual import script_chars_by_slide
from twinscript.operators.segments import extract_text_blocks, filter_slide_range, order_slides
from twinscript.sources import decks, files

NS = (
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" '
    'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
)


def slide(*paragraphs, title=False, body=""):
    kind = "title" if title else "body"
    return (
        f'<p:sld {NS}><p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr>'
        f"<a:txBody>{body}{''.join(f'<a:p>{p}</a:p>' for p in paragraphs)}</a:txBody></p:sp></p:sld>"
    )


def run(text, props=""):
    return f"<a:r>{props}<a:t>{text}</a:t></a:r>"


@pytest.fixture(scope="module")
def deck_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("decks")
    with zipfile.ZipFile(folder / "one.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", slide(run("こんにちは") + run(" World") + "<a:br/>" + run("end"), run("  "), run("&lt;x&gt;"), title=True))
        z.writestr("ppt/slides/slide2.xml", slide('<a:fld><a:rPr/><a:t>12</a:t></a:fld>', run("")))
        z.writestr("ppt/slides/slide10.xml", slide(run("日本")))
        z.writestr("ppt/slides/_rels/slide1.xml.rels", "<r/>")
        z.writestr("ppt/notesSlides/notesSlide1.xml", slide(run("note")))
    with zipfile.ZipFile(folder / "two.pptx", "w") as z:
        styled = run("B", '<a:rPr b="1" i="true" baseline="30000"/>') + run("u", '<a:rPr u="sng"/>') + run("n", '<a:rPr u="none" b="0"/>') + run("s", '<a:rPr baseline="-25000"/>')
        z.writestr("ppt/slides/slide1.xml", slide(styled))
    return str(folder / "*.pptx")


def test_parts_and_paragraphs(spark, deck_dir):
    parts = decks.read_decks(spark, deck_dir)
    assert parts.count() == 5
    rows = decks.extract_paragraphs(parts.filter("part_kind = 'slide'"))
    got = sorted((r.deck_id[-8:], r.part_name, r.para_idx, r.text) for r in rows.collect())
    assert got == [
        ("one.pptx", "ppt/slides/slide1.xml", 0, "こんにちは World\nend"),
        ("one.pptx", "ppt/slides/slide1.xml", 2, "<x>"),
        ("one.pptx", "ppt/slides/slide10.xml", 0, "日本"),
        ("one.pptx", "ppt/slides/slide2.xml", 0, "12"),
        ("two.pptx", "ppt/slides/slide1.xml", 0, "Buns"),
    ]


def test_slides_are_dropped_before_parsing(spark, deck_dir):
    parts = decks.read_decks(spark, deck_dir, slides="2-10", notes=False)
    assert sorted(r.part_no for r in parts.collect()) == [2, 10]


def test_tagged(spark, deck_dir):
    rows = decks.extract_tagged_paragraphs(decks.read_decks(spark, deck_dir).filter("deck_id like '%two%'"))
    assert rows.first().text == "[b][i][sup]B[/sup][/i][/b][u]u[/u]n[sub]s[/sub]"


def test_formatting_records(spark):
    body = '<a:bodyPr lIns="10" bIns="4"/>'
    xml = slide(
        '<a:pPr><a:lnSpc><a:spcPct val="90000"/></a:lnSpc></a:pPr>' + run("a", '<a:rPr sz="1800"><a:latin typeface="Arial"/></a:rPr>'),
        run("b", '<a:rPr sz="2400"><a:latin typeface="Arial"/></a:rPr>') + run("c"),
        title=True, body=body,
    )
    parts = spark.createDataFrame([("d", "slide", "ppt/slides/slide1.xml", 1, xml)], "deck_id string, part_kind string, part_name string, part_no long, xml string")
    row = deck_ops.format_stats(decks.extract_text_runs(parts)).first()
    assert (row.text_frames, row.title_frames, row.body_frames) == (1, 1, 0)
    assert row.font_families == ["Arial"] and row.font_sizes == [1800, 2400] and row.line_spacings == ["90000"]
    assert row.margin_settings == ["left=10,right=default,top=default,bottom=4"]


def test_text_blocks_of_markup(spark):
    """Only element bodies count, so a break between two of them joins nothing."""
    slides = [
        ("d", "slide", "<a:t>こんにちは</a:t><a:t> </a:t><a:t>&lt;tag&gt;</a:t><a:t> &amp; </a:t><a:t>World</a:t>"),
        ("d", "notes", "<a:t>Note2 &amp; more<a:br /><a:br/></a:t><a:br/><a:t> second\r\n\r\n\r\nthird </a:t>"),
        ("d", "empty", "<a:x/>"),
    ]
    df = spark.createDataFrame(slides, "deck_id string, part_kind string, xml string")
    got = sorted((r.part_kind, r.block_idx, r.text) for r in extract_text_blocks(df, "xml").collect())
    assert got == [
        ("notes", 0, "Note2 & more"), ("notes", 1, "second"), ("notes", 2, "third"), ("slide", 0, "こんにちは <tag> & World"),
    ]


def test_slide_order_and_range(spark, deck_dir):
    rows = decks.extract_paragraphs(decks.read_decks(spark, deck_dir, notes=False)).filter("deck_id like '%one%'")
    by_slide = script_chars_by_slide(rows).withColumn("part_no", F.regexp_extract("part_name", r"(\d+)\.xml", 1).cast("long"))
    assert [r.part_no for r in order_slides(by_slide).collect()] == [1, 10, 2]
    assert [r.part_no for r in order_slides(by_slide, natural=True).collect()] == [1, 2, 10]
    assert filter_slide_range(rows, "2-10").count() == 2
    assert filter_slide_range(rows, "7").count() == rows.count()


def test_bilingual_csv(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text(
        'slide_xml,paragraph_idx,Japanese,English\nppt/slides/slide1.xml,3,"日\n本","Ja ""x""\npan"\nshort,1,a\n'
        "ppt/slides/slide2.xml,4,空,\n",
        encoding="utf-8",
    )
    got = sorted((r.slide, r.idx, r.src, r.tgt, r.kind) for r in files.read_bilingual_csv(spark, str(path), "d").collect())
    assert got == [
        ("ppt/slides/slide1.xml", 3, "日\n本", 'Ja "x"\npan', "title"),
        ("ppt/slides/slide2.xml", 4, "空", "", "title"),
    ]


def test_bilingual_csv_with_dos_line_ends(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_bytes("slide_xml,paragraph_idx,Japanese,English\r\ns1,0,日,day\r\ns1,1,\"二\n行\",\"two, lines\"\r\n".encode())
    got = sorted((r.slide, r.idx, r.src, r.tgt) for r in files.read_bilingual_csv(spark, str(path), "d").collect())
    assert got == [("s1", 0, "日", "day"), ("s1", 1, "二\n行", "two, lines")]


def test_kv_json_and_pricing(spark, tmp_path):
    (tmp_path / "tm.json").write_text(json.dumps({"日": "day", "x": ""}, ensure_ascii=False, indent=2), encoding="utf-8")
    got = {r.src: r.tgt for r in files.read_kv_json(spark, str(tmp_path / "tm.json"), "src", "tgt").collect()}
    assert got == {"日": "day", "x": ""}
    (tmp_path / "p.json").write_text(json.dumps({"_meta": {"currency": "USD"}, "acme:u": {"in": 2.0, "out": 5, "tokenizer": "t"}, "a:b": {}}))
    rows = {r.model: r for r in files.read_pricing(spark, str(tmp_path / "p.json")).collect()}
    assert set(rows) == {"acme:u", "a:b"}
    assert rows["acme:u"]["in"] == 2.0 and rows["acme:u"].tokenizer == "t" and rows["acme:u"].provider == "acme"
    assert rows["a:b"].tokenizer == "o200k_base" and rows["a:b"].out is None


def test_run_audits(spark, tmp_path):
    for run_id, after in (("11", 5), ("12", 3)):
        folder = tmp_path / f"run-{run_id}-artifacts"
        folder.mkdir()
        (folder / "audit.json").write_text(
            json.dumps(
                {
                    "unique_strings": 2, "api_calls": 1, "jp_chars_before": 9, "jp_chars_after": after,
                    "per_slide_before": {"s1": 4, "s2": 5}, "per_slide_after": {"s1": 0, "s2": after},
                },
                indent=2,
            )
        )
    audits = files.read_run_audits(spark, str(tmp_path / "run-*" / "audit.json"))
    assert sorted((r.run_id, r.jp_chars_after) for r in audits.collect()) == [("11", 5), ("12", 3)]
    slides = files.slides_of_audits(audits).filter("run_id = '12'")
    assert sorted((r.part_name, r.n_before, r.n_after) for r in slides.collect()) == [("s1", 4, 0), ("s2", 5, 3)]


def test_run_audits_in_an_array(spark, tmp_path):
    record = {"deck_id": "d", "jp_chars_before": 9, "per_slide_before": {"s1": 4, "s2": 5}, "per_slide_after": {"s1": 0}}
    for run_id, records in (("11", [record, {**record, "deck_id": "e"}]), ("12", record), ("13", [])):
        folder = tmp_path / f"run-{run_id}"
        folder.mkdir()
        (folder / "audit.json").write_text(json.dumps(records, indent=2))
    slides = files.slides_of_audits(files.read_run_audits(spark, str(tmp_path / "run-*")))
    assert sorted(map(tuple, slides.collect()), key=repr) == sorted(
        [(run, deck, *s) for run, deck in (("11", "d"), ("11", "e"), ("12", "d")) for s in (("s1", 4, 0), ("s2", 5, None))], key=repr
    )


def test_memory_versions(spark, tmp_path):
    from twinscript.plans.flows import clean_memory

    tm = spark.createDataFrame([("a", "a"), ("日", "day"), ("月", "月x")], "src string, tgt string")
    path = str(tmp_path / "tm")
    files.write_tm(tm, path, "001")
    assert [tuple(r) for r in clean_memory(spark, path, "001", "002").collect()] == [("日", "day")]
    assert files.read_tm(spark, path, "001").count() == 3
    assert files.read_tm(spark, path).count() == 1


def test_csv_round_trip_keeps_texts_whole(spark, tmp_path):
    texts = ["  lead", "trail  ", 'q"u"ote', "a,b", "two\nlines", "cr\rhere", "crlf\r\nend", "back\\slash\\", "\ttab\t", "", "　日本　", '"', "\\\""]
    rows = [("d", "s", i, t, t, "title") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "deck_id string, slide string, idx long, src string, tgt string, kind string")
    path = str(tmp_path / "out")
    files.write_bilingual(df, path)
    got = {r.idx: (r.src, r.tgt) for r in files.read_bilingual_csv(spark, path).collect()}
    assert got == {i: (t, t) for i, t in enumerate(texts)}


def archive(path, parts):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return path


def test_what_cannot_be_read_becomes_a_row(spark, tmp_path):
    good = slide(run("好き"))
    for i in range(9):
        archive(tmp_path / f"good{i}.pptx", {"ppt/slides/slide1.xml": good})
    (tmp_path / "cut.pptx").write_bytes((tmp_path / "good0.pptx").read_bytes()[:-30])
    (tmp_path / "no.pptx").write_bytes(b"text")
    mixed = archive(tmp_path / "mixed.pptx", {"ppt/slides/slide1.xml": good, "ppt/slides/slide2.xml": b"<a>\xff\xfe</a>", "ppt/slides/slide3.xml": good})
    data = bytearray(mixed.read_bytes())
    data[data.rindex(b"ppt/slides/slide3.xml", 0, data.index(b"PK\x01\x02")) + 40] ^= 0xFF
    mixed.write_bytes(bytes(data))
    rows = decks.read_deck_rows(spark, str(tmp_path / "*.pptx"))
    bad = sorted((r.deck_id.rsplit("/", 1)[1], r.part_name) for r in decks.unreadable(rows).collect())
    assert bad == sorted([("cut.pptx", None), ("no.pptx", None), ("mixed.pptx", "ppt/slides/slide2.xml"), ("mixed.pptx", "ppt/slides/slide3.xml")])
    assert all(r.error for r in decks.unreadable(rows).collect())
    assert decks.extract_paragraphs(decks.read_decks(spark, str(tmp_path / "*.pptx"))).count() == 10
    # A slide range is no error and skips damaged slides unread.
    assert decks.read_deck_rows(spark, str(tmp_path / "mixed.pptx"), slides="1-1").filter("error is not null").count() == 0


@pytest.mark.parametrize("encoding,declared", [
    ("utf-16", "UTF-16"), ("utf-16-le", "UTF-16"), ("utf-16-be", "UTF-16"), ("utf-8-sig", None), ("iso-8859-1", "ISO-8859-1"),
    ("shift_jis", "Shift_JIS"), ("utf-32", None), ("utf-8", "utf-8"), ("utf-8", None),
])
def test_parts_in_other_encodings(spark, tmp_path, encoding, declared):
    text = "café" if encoding.startswith("iso") else "日本 x"
    head = f'<?xml version="1.0" encoding="{declared}"?>' if declared else ""
    xml = head + slide(run(text))
    archive(tmp_path / "d.pptx", {"ppt/slides/slide1.xml": xml.encode(encoding)})
    parts = decks.read_decks(spark, str(tmp_path / "d.pptx"))
    assert parts.first().xml == xml
    assert [r.text for r in decks.extract_paragraphs(parts).collect()] == [text]


def test_broken_parts_give_errors_and_no_rows(spark):
    whole = slide(run("one"), run("two"), run("x", '<a:rPr sz="1800"/>'))
    xmls = [whole, whole[:-20], "", None, "<a>", whole.replace('sz="1800"', 'sz="big"')]
    head = "deck_id string, part_kind string, part_name string, part_no long"
    for kind in ("string", "binary"):
        values = [x if kind == "string" or x is None else bytearray(x.encode()) for x in xmls]
        parts = spark.createDataFrame([("d", "slide", f"p{i}", i, x) for i, x in enumerate(values)], f"{head}, xml {kind}")
        rows = decks.paragraph_rows(parts)
        assert sorted(r.part_no for r in decks.unreadable(rows).collect()) == [1, 2, 3, 4]
        assert sorted((r.part_no, r.para_idx, r.text) for r in decks.extract_paragraphs(parts).collect()) == [
            (p, i, t) for p in (0, 5) for i, t in enumerate(("one", "two", "x"))
        ]
        assert sorted(r.part_no for r in decks.unreadable(decks.run_rows(parts)).collect()) == [1, 2, 3, 4, 5]
        assert {r.part_no for r in decks.extract_text_runs(parts).collect()} == {0}
    wide = spark.createDataFrame([("d", "slide", "p", 1, bytearray(('<?xml version="1.0" encoding="UTF-16"?>' + whole).encode("utf-16")))], f"{head}, xml binary")
    assert [r.text for r in decks.extract_paragraphs(wide).collect()] == ["one", "two", "x"]


def test_paragraphs_inside_paragraphs_keep_their_order(spark):
    inner = slide("<a:r><a:t>outer</a:t></a:r><x><a:p><a:r><a:t>inner</a:t></a:r></a:p></x>", run("last"))
    parts = spark.createDataFrame([("d", "slide", "p", 1, inner)], "deck_id string, part_kind string, part_name string, part_no long, xml string")
    assert [(r.para_idx, r.text) for r in decks.extract_paragraphs(parts).orderBy("para_idx").collect()] == [(0, "outerinner"), (1, "inner"), (2, "last")]


def test_rows_leave_in_frames_of_bounded_size(monkeypatch):
    monkeypatch.setattr(decks, "BATCH_CHARS", 100)
    frames = list(decks._frames((("x" * 30,) for _ in range(20)), ["t"], {}, lambda row: len(row[0])))
    assert [len(f) for f in frames] == [4, 4, 4, 4, 4, 0]


class Captured:
    """Stands for a DataFrame and runs what is mapped over it on batches of its own."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *_):
        return self

    def mapInArrow(self, function, _):
        return function(iter([self.batch]))


def most_held(rows_of, wanted):
    """Rows that leave, and the most MB of Python objects meanwhile, for 24 MB of parts in one batch."""
    import tracemalloc

    import pyarrow as pa

    xml = slide(*[run("word " * 80, '<a:rPr b="1" sz="1800"/>') for _ in range(17)])
    count = 24_000_000 // len(xml)
    head = {"deck_id": ["d"] * count, "part_kind": ["slide"] * count, "part_name": [f"p{i}" for i in range(count)], "part_no": list(range(count))}
    batch = pa.RecordBatch.from_pydict({**head, "xml": [xml + " " * (i % 7) for i in range(count)]})
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in rows_of(Captured(batch)))
        return n == count * wanted, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_runs_of_a_batch_are_not_held_whole():
    whole, megabytes = most_held(lambda parts: decks._parsed(
        parts, lambda data, _: list(decks._frame_records(decks.ElementTree.fromstring(data))),
        ["frame_idx", "is_title", "record", "margins", "line_spacing", "font_size", "font_family"],
        {"frame_idx": "Int64", "font_size": "Int32"}, decks.schemas.RUNS,
    ), 18)
    assert whole and megabytes < 16


@pytest.mark.parametrize("tagged", [False, True])
def test_paragraphs_of_a_batch_are_not_held_whole(tagged):
    whole, megabytes = most_held(lambda parts: decks._parsed(
        parts, decks._paragraph_records(tagged), ["para_idx", "text"], {"para_idx": "Int64"}, decks.schemas.SEGMENTS
    ), 17)
    assert whole and megabytes < 40


def test_decks_in_a_bundle(spark, tmp_path):
    whole = tmp_path / "whole.bin"
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("ppt/slides/slide1.xml", slide(run("one")))
        z.writestr("ppt/embeddings/inner.pptx", b"no deck of its own")
    folder = tmp_path / "decks"
    folder.mkdir()
    (folder / "alone.pptx").write_bytes(whole.read_bytes())
    with zipfile.ZipFile(folder / "many.zip", "w") as z:
        for n in range(30):
            z.writestr(f"sub/{n}.pptx", whole.read_bytes()[: 40 if n == 7 else None])
        z.writestr("readme.txt", "x")
    rows = decks.read_deck_rows(spark, str(folder))
    got = {r.deck_id.split("/decks/")[1]: r.error for r in rows.collect()}
    assert sorted(got) == sorted(["alone.pptx"] + [f"many.zip/sub/{n}.pptx" for n in range(30)])
    assert [k for k, error in got.items() if error] == ["many.zip/sub/7.pptx"]


def test_bilingual_files_name_their_decks(spark, tmp_path):
    rows = [("a.pptx", "s1", 0, "日", "day", "title"), ("b, c.pptx", "s1", 0, "日", "", "title"), (None, "s2", 1, "", "x", "title")]
    df = spark.createDataFrame(rows, "deck_id string, slide string, idx long, src string, tgt string, kind string")
    path = str(tmp_path / "out")
    files.write_bilingual(df, path)
    assert sorted(map(tuple, files.read_bilingual_csv(spark, path).collect()), key=repr) == sorted(rows, key=repr)
    assert {r.deck_id for r in files.read_bilingual_csv(spark, path, "mine").collect()} == {"mine"}


def test_a_reader_sees_no_unfinished_version(spark, tmp_path):
    tm = spark.createDataFrame([("a", "b")], "src string, tgt string")
    path = str(tmp_path / "tm")
    files.write_tm(tm, path, "001")
    # A version whose files are there, but whose write has not ended.
    tm.unionByName(tm).write.parquet(f"{path}/version=002")
    assert files.tm_versions(spark, path) == ["001"] and files.read_tm(spark, path).count() == 1
    files.write_tm(tm.limit(0), path, "003")
    assert files.read_tm(spark, path).count() == 0 and files.read_tm(spark, path, "001").count() == 1
    # No other version is listed.
    assert all("version=003" in f for f in files.read_tm(spark, path).inputFiles())


def test_objects_by_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": "1", "b": "2"}\n{"a": "3"}\n', encoding="utf-8")
    got = sorted(map(tuple, files.read_kv_json(spark, str(tmp_path / "x.jsonl"), lines=True).collect()))
    assert got == [("a", "1"), ("a", "3"), ("b", "2")]
