"""Building blocks of the check SQL (DuckDB dialect)."""

from twinscript import rules
from twinscript.catalog import workloads as w

ANY, CORE, COST = rules.SCRIPT_ANY, rules.SCRIPT_CORE, rules.SCRIPT_COST
WS = r"\s\v\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(t: str, cls: str = ANY) -> str:
    return f"regexp_matches({t}, '[{cls}]')"


def count(t: str, cls: str = ANY) -> str:
    return f"CAST(length(regexp_replace({t}, '[^{cls}]', '', 'g')) AS BIGINT)"


def core_count(t: str) -> str:
    return count(f"replace(replace({t}, '・', ''), '　', '')", CORE)


def script_chars(t: str, cls: str = CORE) -> str:
    return f"regexp_replace({t}, '[^{cls}]', '', 'g')"


def nonblank(t: str) -> str:
    return f"regexp_matches({t}, '[^{WS}]')"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def rstrip(t: str) -> str:
    return f"regexp_replace({t}, '[{WS}]+$', '')"


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '[{WS}]+', ' ', 'g'))"


def untag(t: str) -> str:
    return rf"regexp_replace({t}, '\[/?[^\]]+\]', '', 'g')"


def words(t: str) -> str:
    return f"regexp_extract_all({t}, '[^{WS}]+')"


def n_words(t: str) -> str:
    return f"len({words(t)})"


def marks(t: str) -> str:
    return f"len(regexp_extract_all({t}, '[.!?]+'))"


def preview(t: str, n: int = 50) -> str:
    return f"(left({t}, {n}) || CASE WHEN length({t}) > {n} THEN '...' ELSE '' END)"


def replace_chain(t: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        t = f"replace({t}, {quote(a)}, {quote(b)})"
    return t


def rx(t: str, pattern: str, wanted: str) -> str:
    return f"regexp_replace({t}, {quote(pattern)}, {quote(wanted)}, 'g')"


def normalize_punctuation(t: str) -> str:
    t = replace_chain(t, *rules.PUNCTUATION.items())
    t = replace_chain(t, (" ,", ","), (" .", "."), (" %", "%"), (" )", ")"), ("( ", "("))
    t = rx(t, f"[{WS}]*–[{WS}]*", "–")
    t = rx(t, rf"(\p{{Nd}})[{WS}]*-[{WS}]*(\p{{Nd}})", r"\1–\2")
    t = rx(t, f'"[{WS}]+', '"')
    t = rx(t, f'[{WS}]+"', '"')
    return collapse(t)


def normalize_mechanics(t: str) -> str:
    t = replace_chain(t, *rules.MECHANICS_PUNCTUATION.items())
    t = replace_chain(t, (" ,", ","), (" .", "."), (" %", "%"), (" ;", ";"), (" :", ":"))
    t = rx(t, rf"(\p{{Nd}})[{WS}]*-[{WS}]*(\p{{Nd}})", r"\1–\2")
    t = rx(t, f"[{WS}]*[〜～][{WS}]*", "–")
    t = rx(t, f"[{WS}]*–[{WS}]*", "–")
    return collapse(t)


def bullet_fragment(t: str, closing: str = ".;:") -> str:
    s = strip(t)
    return f"(CASE WHEN {marks(s)} <= 1 THEN regexp_replace({s}, '[{closing}]$', '') ELSE {s} END)"


def kind(t: str) -> str:
    bare = untag(t)
    return (
        f"(CASE WHEN {n_words(bare)} <= 12 AND NOT regexp_matches({bare}, '[.:;][{WS}]*$') "
        "THEN 'title' ELSE 'bullet' END)"
    )


def title_case(t: str) -> str:
    small = "[" + ", ".join(quote(s) for s in rules.SMALL_WORDS) + "]"
    return (
        f"(list_transform([{words(t)}], lambda ws: CASE WHEN len(ws) = 0 THEN {t} ELSE "
        "array_to_string(list_transform(ws, lambda w, i: CASE WHEN contains(w, '[') AND contains(w, ']') THEN w "
        f"WHEN i > 1 AND i < len(ws) AND list_contains({small}, lower(w)) THEN lower(w) "
        "WHEN w = lower(w) AND w <> upper(w) THEN replace(upper(left(w, 1)), 'ẞ', 'SS') || substr(w, 2) "
        "ELSE w END), ' ') END)[1])"
    )


def title_case_tagged(t: str) -> str:
    tag = r"\[/?[^\]]+\]"
    return (
        f"(SELECT array_to_string(list_transform(string_split_regex(x, '{tag}'), lambda p, k: "
        f"(CASE WHEN starts_with(p, '[') AND ends_with(p, ']') THEN p ELSE {title_case('p')} END) "
        f"|| coalesce(regexp_extract_all(x, '{tag}')[k], '')), '') FROM (SELECT {t} AS x))"
    )


def has_phrase(t: str, phrase: str) -> str:
    return f"regexp_matches({t}, {quote(f'(^|[^{WORD}])(?i:{phrase})($|[^{WORD}])')})"


def replace_phrase(t: str, phrase: str, wanted: str, ignore_case: bool = True) -> str:
    """Whole-word replace; run twice because neighbours share a boundary character."""
    body = f"(?i:{phrase})" if ignore_case else f"(?:{phrase})"
    for _ in range(2):
        t = rx(t, f"(^|[^{WORD}]){body}($|[^{WORD}])", rf"\1{wanted}\2")
    return t


def replace_banned(t: str, banned: dict[str, str] | None = None) -> str:
    for phrase, wanted in (w.BANNED if banned is None else banned).items():
        t = replace_phrase(t, phrase.upper(), wanted.upper(), ignore_case=False)
        t = replace_phrase(t, phrase.title(), wanted.capitalize(), ignore_case=False)
        t = replace_phrase(t, phrase, wanted)
    return t


def phrase_matches(t: str, banned: dict[str, str] | None = None) -> str:
    """Every whole-word match; separators are doubled so that each match has its own."""
    phrases = "|".join(w.BANNED if banned is None else banned)
    doubled = rx(t, f"([^{WORD}])", r"\1\1")
    return f"regexp_extract_all({doubled}, {quote(f'(?:^|[^{WORD}])((?i:{phrases}))(?:$|[^{WORD}])')}, 1)"


def ratio(src: str, tgt: str) -> str:
    return f"(CASE WHEN length({strip(src)}) > 0 THEN length({strip(tgt)}) / length({strip(src)}) ELSE 1.0::DOUBLE END)"


def threshold(k: str) -> str:
    return f"(CASE {k} WHEN 'title' THEN 1.8::DOUBLE WHEN 'table' THEN 1.2::DOUBLE ELSE 1.4::DOUBLE END)"


def values(rows: list[tuple], columns: str) -> str:
    def lit(v) -> str:
        return quote(v) if isinstance(v, str) else "NULL" if v is None else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({columns}))"


GLOSSARY = values(w.GLOSSARY, "term, expected")
ALTERNATIVES = values([(t, a, i) for t, alts in w.ALTERNATIVES.items() for i, a in enumerate(alts)], "term, alt, place")
BANNED = values([(k, v, i) for i, (k, v) in enumerate(w.BANNED.items())], "phrase, suggested, place")
MARKS = values([(k, v, i) for i, (k, v) in enumerate(w.MARKS.items())], "original, correct, place")

_KANA = f"'{w.LATIN}', '{w.KANA}'"
_BACK = f"'{w.KANA}', '{w.LATIN}'"

COMMON = f"""
documents_as_parts AS (
  SELECT source AS deck_id, 'slide' AS part_kind, 'ppt/slides/slide' || doc_id || '.xml' AS part_name,
         doc_id AS part_no, doc_id, lang, text
  FROM documents
),
parts AS (
  SELECT * REPLACE (CASE WHEN lang <> 'en' THEN translate(text, {_KANA}) ELSE text END AS text) FROM documents_as_parts
),
segments AS (
  SELECT * FROM (
    SELECT * EXCLUDE (text), unnest(string_split(text, chr(10))) AS text,
           unnest(range(len(string_split(text, chr(10))))) AS para_idx
    FROM parts
  ) WHERE {nonblank('text')}
),
plain AS (
  SELECT * FROM (
    SELECT * EXCLUDE (text), unnest(string_split(text, chr(10))) AS line,
           unnest(range(len(string_split(text, chr(10))))) AS idx
    FROM documents_as_parts
  ) WHERE {nonblank('line')}
),
pairs AS (
  SELECT deck_id, part_name AS slide, idx,
         translate(line, '{w.LATIN}nrst', '{w.KANA}') AS src,
         CASE lang WHEN 'fr' THEN '[b]' || line || CASE WHEN ends_with(line, '.') THEN '[/b]' ELSE '' END
                   WHEN 'de' THEN replace(line, 'und', 'おと')
                   WHEN 'es' THEN '• ' || line
                   ELSE line END AS tgt
  FROM plain
),
bilingual AS (
  SELECT *, CASE WHEN {n_words('tgt')} <= 12 THEN 'title' ELSE 'bullet' END AS kind FROM pairs
),
checked AS (SELECT slide AS batch_id, idx AS "index", tgt AS text FROM bilingual),
tm AS (
  SELECT text AS src,
         CASE WHEN max(toxic) = 1 THEN text WHEN max(quality) = 0 THEN 'TM ' || text
              ELSE translate(text, {_BACK}) END AS tgt
  FROM segments JOIN labels USING (doc_id) WHERE {has('text')} GROUP BY text
),
tm_runs AS (SELECT p_name AS src, p_size AS run_id, p_brand AS tgt FROM part),
glossary AS {GLOSSARY},
alternatives AS {ALTERNATIVES},
banned AS {BANNED},
marks AS {MARKS}
"""


def using(body: str, *ctes: str) -> str:
    """A query over the common tables and further ones."""
    return "WITH " + ",\n".join([COMMON.strip(), *ctes]) + "\n" + body
