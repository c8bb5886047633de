"""Slide decks: archives to parts, parts to paragraphs and formatting records.

Only the archive and its XML are read in Python, one Arrow batch at a time; all
filtering that can happen before parsing does. An archive or part that cannot be
read ends no job: it becomes a row with its ``error``, which the plain readers
leave out and ``*_rows`` keep.
"""

import codecs
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from twinscript import schemas
from twinscript.functions.text import is_nonblank
from twinscript.operators.segments import filter_nonblank, is_notes_name, is_slide_name, slide_bounds, slide_no

# XML namespaces of drawing and presentation markup.
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
PRESENTATION = "{http://schemas.openxmlformats.org/presentationml/2006/main}"

BATCH_CHARS = 4_000_000
BATCH_ROWS = 10_000
SLICE_ROWS = 64
KEYS = ["deck_id", "part_kind", "part_name", "part_no"]

# Damaged or encrypted members, unknown compression, bytes outside the encoding.
DAMAGED = (zipfile.BadZipFile, zlib.error, OSError, EOFError, ValueError, RuntimeError, NotImplementedError)

# Where a deck keeps its parts, and how a bundle names its decks.
DECK_FOLDER, DECK_SUFFIX = "ppt/", ".pptx"

# Inline style tags in opening order.
STYLE_TAGS = ["b", "i", "u", "sup", "sub"]

# What an XML file in a wide encoding begins with, byte order marks first.
BEGINNINGS = [
    (codecs.BOM_UTF8, "utf-8-sig"),
    (codecs.BOM_UTF32_LE, "utf-32"),
    (codecs.BOM_UTF32_BE, "utf-32"),
    (codecs.BOM_UTF16_LE, "utf-16"),
    (codecs.BOM_UTF16_BE, "utf-16"),
    (b"<\0?\0", "utf-16-le"),
    (b"\0<\0?", "utf-16-be"),
]
DECLARED = re.compile(rb"""^\s*<\?xml[^>]*?\bencoding\s*=\s*["']([A-Za-z][A-Za-z0-9._-]*)["']""")


def markup_text(data: bytes) -> str:
    """The text of an XML file in its own encoding; a ``ValueError`` if it is not in it."""
    for beginning, encoding in BEGINNINGS:
        if data.startswith(beginning):
            return data.decode(encoding)
    declared = DECLARED.match(data[:1024])
    try:
        return data.decode(declared[1].decode() if declared else "utf-8")
    except LookupError as unknown:
        raise ValueError(str(unknown)) from None


def _described(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def read_deck_rows(spark: SparkSession, glob: str, slides: str | None = None, notes: bool = True) -> DataFrame:
    """Like :func:`read_decks`, with a row for all that could not be read; see :func:`deck_rows`.

    A file of no bytes gives no row: Spark plans no read for it.
    """
    files = spark.read.format("binaryFile").load(glob).select(F.col("path").alias("deck_id"), "content")
    return deck_rows(files, slides, notes)


def read_decks(spark: SparkSession, glob: str, slides: str | None = None, notes: bool = True) -> DataFrame:
    """Slide and notes parts of every deck file matching ``glob``.

    ``slides`` (``'3-7'``) drops other slides before anything is decompressed. What
    cannot be read is left out; :func:`read_deck_rows` names it.
    """
    return _readable(read_deck_rows(spark, glob, slides, notes))


def unpack_decks(files: DataFrame, slides: str | None = None, notes: bool = True) -> DataFrame:
    """Parts of archives given as ``deck_id, content``, as far as they can be read."""
    return _readable(deck_rows(files, slides, notes))


def _readable(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("error").isNull()).drop("error")


def unreadable(rows: DataFrame) -> DataFrame:
    """Deck, part and error of what could not be read, from ``deck_rows``, ``paragraph_rows`` or ``run_rows``.

    Without a part the whole archive is meant.
    """
    return rows.filter(F.col("error").isNotNull()).select(*KEYS, "error")


def deck_rows(files: DataFrame, slides: str | None = None, notes: bool = True) -> DataFrame:
    """Parts of archives with ``error``: null, or why the archive (no part) or the part (no xml) cannot be read.

    A null archive counts as an empty file. An archive without a ``ppt`` folder is a bundle:
    each ``.pptx`` in it is a deck, named ``<bundle>/<member>``. Keep small decks in bundles:
    a file of its own costs Spark a listing and a part of a task. Parts are decoded by their byte order mark
    or XML declaration, without one as UTF-8.
    """
    bounds = slide_bounds(slides)

    def wanted(name: str) -> str | None:
        kind = "slide" if is_slide_name(name) else "notes" if notes and is_notes_name(name) else None
        number = slide_no(name)
        if kind and bounds and not (number is not None and bounds[0] <= number <= bounds[1]):
            return None
        return kind

    def decks_of(bundle: str, archive: zipfile.ZipFile) -> Iterator[tuple]:
        for member in archive.infolist():
            if not member.filename.lower().endswith(DECK_SUFFIX):
                continue
            deck_id = f"{bundle}/{member.filename}"
            try:
                content = archive.read(member)
            except DAMAGED as error:
                yield deck_id, None, None, None, None, _described(error)
                continue
            yield from parts_of(deck_id, content, bundles=False)

    def parts_of(deck_id: str, content: bytes | None, bundles: bool = True) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content or b""))
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as error:
            yield deck_id, None, None, None, None, _described(error)
            return
        with archive:
            # A deck may embed other decks; they lie in its own folder.
            if bundles and not any(name.startswith(DECK_FOLDER) for name in archive.namelist()):
                yield from decks_of(deck_id, archive)
                return
            for name in archive.namelist():
                kind = wanted(name)
                if kind is None:
                    continue
                xml = problem = None
                try:
                    xml = markup_text(archive.read(name))
                except DAMAGED as error:
                    problem = _described(error)
                yield deck_id, kind, name, slide_no(name), xml, problem

    def unpack(cells: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        rows = (row for pair in cells for row in parts_of(*pair))
        # A large deck leaves in pieces and is never held decompressed.
        yield from _frames(rows, [*KEYS, "xml", "error"], {"part_no": "Int64"}, lambda row: len(row[4] or ""))

    return _map_cells(files.select("deck_id", "content"), unpack, schemas.PARTS + ", error string")


def _map_cells(df: DataFrame, function: Callable[[Iterator[tuple]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Rows as tuples in, frames out; of an Arrow batch only ``SLICE_ROWS`` rows at a time are Python values."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                yield from zip(*(column.to_pylist() for column in batch.slice(start, SLICE_ROWS).columns))
            # The next batch is read while this name still holds the last one.
            del batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in function(cells(batches)):
            yield pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)

    return df.mapInArrow(run, schema)


def _frames(rows: Iterable[tuple], names: list[str], kinds: dict[str, str], size: Callable[[tuple], int]) -> Iterator[pd.DataFrame]:
    """Rows in frames of bounded size."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight > BATCH_CHARS or len(held) >= BATCH_ROWS:
            yield pd.DataFrame(held, columns=names).astype(kinds)
            held, weight = [], 0
    yield pd.DataFrame(held, columns=names).astype(kinds)


def _parsed(parts: DataFrame, records: Callable[[bytes], list[tuple]], names: list[str], kinds: dict[str, str], schema: str) -> DataFrame:
    """What ``records`` finds in every part, one part at a time; a part that is no XML gives one row with its error.

    ``xml`` may be text or bytes.
    """

    def rows_of(head: tuple, xml: str | bytes | None) -> Iterator[tuple]:
        try:
            data = xml.encode() if isinstance(xml, str) else bytes(xml or b"")
            found = records(data, isinstance(xml, str))
        except (ElementTree.ParseError, ValueError, LookupError) as error:
            yield (*head, *[None] * len(names), _described(error))
            return
        for record in found:
            yield (*head, *record, None)

    def parse(cells: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        rows = (row for *head, xml in cells for row in rows_of(tuple(head), xml))
        columns = [*KEYS, *names, "error"]
        yield from _frames(rows, columns, {"part_no": "Int64", **kinds}, lambda row: sum(len(v) for v in row if isinstance(v, str)))

    return _map_cells(parts.select(*KEYS, "xml"), parse, schema + ", error string")


def _run_style(run) -> list[str]:
    props = run.find(DRAWING + "rPr")
    if props is None:
        return []
    try:
        shift = int(props.get("baseline") or 0)
    except ValueError:
        shift = 0
    on = {
        "b": props.get("b") in ("1", "true"),
        "i": props.get("i") in ("1", "true"),
        "u": props.get("u") not in (None, "", "none"),
        "sup": shift > 0,
        "sub": shift < 0,
    }
    return [tag for tag in STYLE_TAGS if on[tag]]


def _paragraph_text(paragraph, tagged: bool) -> str:
    pieces = []
    for node in paragraph:
        if node.tag == DRAWING + "br":
            pieces.append("\n")
        elif node.tag == DRAWING + "r":
            text = node.findtext(DRAWING + "t") or ""
            styles = _run_style(node) if tagged and text else []
            pieces += [f"[{s}]" for s in styles] + [text] + [f"[/{s}]" for s in reversed(styles)]
        else:
            pieces.append(node.findtext(f".//{DRAWING}t") or "")
    return "".join(pieces)


def _paragraph_records(tagged: bool) -> Callable[[bytes, bool], list[tuple]]:
    def records(data: bytes, is_text: bool) -> list[tuple]:
        """Index and text of each paragraph. Paragraphs are taken as they end, and what they held is let go."""
        found, open_, count = [], [], 0
        encoding = "utf-8" if is_text else None
        parser = ElementTree.XMLParser(encoding=encoding)
        for event, node in ElementTree.iterparse(io.BytesIO(data), ("start", "end"), parser=parser):
            if node.tag != DRAWING + "p":
                continue
            if event == "start":
                open_.append(count)
                count += 1
            else:
                found.append((open_.pop(), _paragraph_text(node, tagged)))
                if not open_:
                    node.clear()
        return sorted(found, key=lambda row: row[0])

    return records


def paragraph_rows(parts: DataFrame, tagged: bool = False) -> DataFrame:
    """Non-blank paragraphs with ``error``: null, or why their part is no XML (no paragraph then).

    A broken part gives none of its paragraphs. ``xml`` may be text, or bytes in the
    encoding they declare; a null one is broken.
    """
    rows = _parsed(parts, _paragraph_records(tagged), ["para_idx", "text"], {"para_idx": "Int64"}, schemas.SEGMENTS)
    return rows.filter(F.col("error").isNotNull() | is_nonblank(F.col("text")))


def extract_paragraphs(parts: DataFrame) -> DataFrame:
    """One row per non-blank paragraph; the index counts blank ones too. Broken parts are left out (:func:`paragraph_rows`)."""
    return filter_nonblank(_readable(paragraph_rows(parts)))


def extract_tagged_paragraphs(parts: DataFrame) -> DataFrame:
    """The same with style tags around each styled run."""
    return filter_nonblank(_readable(paragraph_rows(parts, tagged=True)))


def _frame_records(root) -> Iterator[tuple]:
    """(frame_idx, is_title, record, margins, line_spacing, font_size, font_family)."""
    frame_idx = -1
    for shape in root.iter(PRESENTATION + "sp"):
        holder = shape.find(f".//{PRESENTATION}nvSpPr/{PRESENTATION}nvPr/{PRESENTATION}ph")
        is_title = holder is not None and holder.get("type") in ("title", "ctrTitle")
        for frame in shape.iter(DRAWING + "txBody"):
            frame_idx += 1
            body = frame.find(DRAWING + "bodyPr")
            margins = None
            if body is not None:
                margins = ",".join(
                    f"{side}={body.get(key, 'default')}"
                    for side, key in (("left", "lIns"), ("right", "rIns"), ("top", "tIns"), ("bottom", "bIns"))
                )
            yield frame_idx, is_title, "frame", margins, None, None, None
            for paragraph in frame.iter(DRAWING + "p"):
                spacing = paragraph.find(f"{DRAWING}pPr/{DRAWING}lnSpc/{DRAWING}spcPct")
                if spacing is not None:
                    yield frame_idx, is_title, "spacing", None, spacing.get("val", "default"), None, None
                for run in paragraph.iter(DRAWING + "r"):
                    props = run.find(DRAWING + "rPr")
                    if props is None:
                        continue
                    latin = props.find(DRAWING + "latin")
                    size = props.get("sz")
                    yield (
                        frame_idx, is_title, "run", None, None,
                        int(size) if size else None,
                        (latin.get("typeface") or None) if latin is not None else None,
                    )


def run_rows(parts: DataFrame) -> DataFrame:
    """Formatting records with ``error``: null, or why their part cannot be parsed (no record then)."""
    names = ["frame_idx", "is_title", "record", "margins", "line_spacing", "font_size", "font_family"]

    def records(data: bytes, is_text: bool) -> list[tuple]:
        return list(_frame_records(ElementTree.fromstring(data, ElementTree.XMLParser(encoding="utf-8" if is_text else None))))

    return _parsed(parts, records, names, {"frame_idx": "Int64", "font_size": "Int32"}, schemas.RUNS)


def extract_text_runs(parts: DataFrame) -> DataFrame:
    """Formatting records of each part: frames, paragraph spacings and styled runs. Broken parts are left out."""
    return _readable(run_rows(parts))
