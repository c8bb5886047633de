"""Whitespace, tags, punctuation, words and previews."""

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinscript import rules

TAG = r"\[/?[^\]]+\]"
# What (?U)\s matches but a space, spelled out: far quicker to look for.
OTHER_SPACE = r"[\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
TERMINAL = r"(?U)[.;:]\s*$"
TERMINAL_WIDE = r"(?U)[.;:。；：]\s*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def splice(
    text: Column, pattern: str, render: Callable[[Column, Column], Column], found: Column | None = None
) -> Column:
    """Replace the i-th match of ``pattern`` by ``render(match, i)``.

    ``found`` are the matches when the caller has them already.
    """
    def interleave(hits: Column) -> Column:
        pieces = F.transform(
            F.split(text, pattern, -1),
            lambda piece, i: F.concat(piece, F.coalesce(render(F.get(hits, i), i), F.lit(""))),
        )
        return F.when(F.size(hits) == 0, text).otherwise(F.array_join(pieces, ""))

    return let(matches(text, pattern), interleave) if found is None else interleave(found)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")


def strip_text(text: Column) -> Column:
    """Trim Unicode whitespace at both ends. Most texts have none there, and only their ends are looked at."""
    at_start = r"(?U)\A\s"
    return let(
        text,
        lambda t: F.when(
            t.rlike(at_start) | F.right(t, F.lit(1)).rlike(at_start), F.regexp_replace(t, r"(?U)\A\s+|\s+\z", "")
        ).otherwise(t),
    )


def collapse_whitespace(text: Column) -> Column:
    """Each run of whitespace as one space. Texts with single spaces only, which are most, pass one plain pattern."""
    return let(
        text, lambda t: F.trim(F.when(t.rlike(f"  |{OTHER_SPACE}"), F.regexp_replace(t, r"(?U)\s+", " ")).otherwise(t))
    )


def is_nonblank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def has_at_most(text: Column, n: int) -> Column:
    """Whether a text has ``n`` words or fewer; a long one is read only as far as its next word."""
    return ~text.rlike(rf"(?U)\A\s*+(?:\S++\s++){{{n}}}\S")


def sentence_marks(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[.!?]+"))


def preview(text: Column, size: int = 50, always: bool = False) -> Column:
    """The first ``size`` characters, with dots when something was cut (or always)."""
    head = F.substring(text, 1, size)
    if always:
        return F.concat(head, F.lit("..."))
    return F.concat(head, F.when(F.length(text) > size, "...").otherwise(""))


def replace_marks(text: Column, table: dict[str, str]) -> Column:
    """Replace single characters by the strings of ``table``."""
    single = {k: v for k, v in table.items() if len(v) == 1}

    def replaced(t: Column) -> Column:
        held, out = F.lit(False), F.translate(t, "".join(single), "".join(single.values()))
        for mark, replacement in table.items():
            held = held | t.contains(mark)
            if mark not in single:
                out = F.replace(out, F.lit(mark), F.lit(replacement))
        return F.when(held, out).otherwise(t)

    return let(text, replaced)


def _close_up(text: Column, *pairs: tuple[str, str]) -> Column:
    for found, wanted in pairs:
        text = F.replace(text, F.lit(found), F.lit(wanted))
    return text


def _replaced(text: Column, marks: str, *steps: tuple[str, str]) -> Column:
    """Patterns that need one of ``marks`` replaced; a text without them runs none."""
    def replaced(t: Column) -> Column:
        held, out = F.lit(False), t
        for mark in marks:
            held = held | t.contains(mark)
        for pattern, wanted in steps:
            out = F.regexp_replace(out, pattern, wanted)
        return F.when(held, out).otherwise(t)

    return let(text, replaced)


def normalize_punctuation(text: Column) -> Column:
    text = replace_marks(text, rules.PUNCTUATION)
    text = _close_up(text, (" ,", ","), (" .", "."), (" %", "%"), (" )", ")"), ("( ", "("))
    text = _replaced(text, "–", (r"(?U)\s*–\s*", "–"))
    text = _replaced(text, "-", (r"(?U)(\d)\s*-\s*(\d)", "$1–$2"))
    text = _replaced(text, '"', (r'(?U)"\s+', '"'), (r'(?U)\s+"', '"'))
    return collapse_whitespace(text)


def normalize_mechanics(text: Column) -> Column:
    text = replace_marks(F.coalesce(text, F.lit("")), rules.MECHANICS_PUNCTUATION)
    text = _close_up(text, (" ,", ","), (" .", "."), (" %", "%"), (" ;", ";"), (" :", ":"))
    text = _replaced(text, "-", (r"(?U)(\d)\s*-\s*(\d)", "$1–$2"))
    text = _replaced(text, "〜～", (r"(?U)\s*[〜～]\s*", "–"))
    text = _replaced(text, "–", (r"(?U)\s*–\s*", "–"))
    return collapse_whitespace(text)


def bullet_fragment(text: Column, wide: bool = False) -> Column:
    """Drop one closing mark unless the text holds several sentences.

    ``wide`` is the mechanics variant, which also drops full-width marks and
    reads null as empty.
    """
    if wide:
        text = F.coalesce(text, F.lit(""))
    return let(
        strip_text(text),
        lambda s: F.when(
            sentence_marks(s) <= 1, F.regexp_replace(s, TERMINAL_WIDE if wide else TERMINAL, "")
        ).otherwise(s),
    )


def classify_segment_kind(
    text: Column, is_title: Column | None = None, is_bullet: Column | None = None
) -> Column:
    """``title`` or ``bullet``; hints win over the shape of the text."""
    by_shape = let(
        strip_tags(text),
        lambda bare: F.when(
            has_at_most(bare, rules.TITLE_MAX_WORDS) & ~bare.rlike(r"(?U)[.:;]\s*\z"), "title"
        ).otherwise("bullet"),
    )
    kind = by_shape
    if is_bullet is not None:
        kind = F.when(is_bullet, "bullet").otherwise(kind)
    if is_title is not None:
        kind = F.when(is_title, "title").otherwise(kind)
    return kind


def classify_kind_by_length(text: Column) -> Column:
    return F.when(has_at_most(text, rules.TITLE_MAX_WORDS), "title").otherwise("bullet")


# The named entities of XML.
XML_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}

# What may be a reference, with or without its semicolon.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[^\t\n\f <&#;]{1,32};?)"
REPLACEMENT = "\ufffd"


def _windows_character(n: int) -> str:
    """What a number from 128 to 159 stands for on the web; the five without a character are themselves."""
    try:
        return bytes([n]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(n)


def _code_point(ref: Column) -> Column:
    """The character of a numeric reference, however long.

    Zero, surrogates and numbers beyond Unicode give the replacement character; control
    characters and numbers that are no characters give none.
    """
    is_hex = ref.rlike("^&#[xX]")
    digits = F.upper(F.regexp_extract(ref, r"^&#[xX]?0*([0-9A-Fa-f]*)", 1))
    short = F.length(digits) <= F.when(is_hex, 6).otherwise(7)
    few = F.when(digits == "", "0").otherwise(F.substring(digits, 1, 7))
    number = F.when(is_hex, F.conv(few, 16, 10)).otherwise(few).try_cast("long")
    within = short & number.isNotNull() & (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    control = (number < 9) | number.between(14, 31) | number.isin(11, 127)
    no_character = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    windows = F.array(*[F.lit(_windows_character(n)) for n in range(128, 160)])
    return (
        F.when(~within | within.isNull(), REPLACEMENT)
        .when(number.between(128, 159), F.get(windows, (number - 128).cast("int")))
        .when(control | no_character, "")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    )


def unescape_markup(text: Column) -> Column:
    """Decode character references in one pass, so that ``&amp;lt;`` becomes ``&lt;``.

    Names come from the standard library's table. Where no name fits the whole reference,
    the longest name known without a semicolon that it begins with is decoded and the rest
    kept (``&copy2020``); a reference that begins with none stays as it is.
    """
    table = json.dumps({f"&{name}": char for name, char in html5.items()})
    named = F.from_json(F.lit(table), "map<string,string>")
    open_names = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))

    def by_name(ref: Column) -> Column:
        begins = F.regexp_extract(ref, f"^&(?:{'|'.join(open_names)})", 0)
        prefix = F.when(begins != "", F.concat(F.try_element_at(named, begins), F.substring(ref, F.length(begins) + 1, F.length(ref))))
        return F.coalesce(F.try_element_at(named, ref), prefix, ref)

    def decode(ref: Column) -> Column:
        decoded = F.when(ref.rlike("^&#[0-9xX]"), _code_point(ref))
        for entity, char in XML_ENTITIES.items():
            decoded = decoded.when(ref == entity, char)
        return F.when(ref.isNotNull(), decoded.otherwise(by_name(ref)))

    return F.when(text.contains("&"), splice(text, REFERENCE, lambda ref, _: decode(ref))).otherwise(text)
