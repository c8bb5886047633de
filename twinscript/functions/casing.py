"""Title case, phrase replacement and whole-block normalisation."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinscript import rules
from twinscript.functions.text import (
    TAG,
    bullet_fragment,
    classify_segment_kind,
    collapse_whitespace,
    is_nonblank,
    let,
    matches,
    normalize_mechanics,
    normalize_punctuation,
    splice,
    words,
)


def title_case(text: Column, small_words: list[str] | None = None) -> Column:
    """Capitalise lower-case words except inner small words.

    Words that carry capitals keep them, bracketed words are left alone, and
    whitespace between words becomes one space.
    """
    small = [w.lower() for w in (rules.SMALL_WORDS if small_words is None else small_words)]

    def cased(word: Column, i: Column, last: Column) -> Column:
        lower = F.lower(word)
        inner_small = lower.isin(small) & (i > 0) & (i < last)
        all_lower = (word == lower) & (word != F.upper(word))
        return (
            F.when(word.contains("[") & word.contains("]"), word)
            .when(inner_small, lower)
            .when(all_lower, F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 2**31 - 1)))
            .otherwise(word)
        )

    return let(
        words(text),
        lambda ws: F.when(F.size(ws) == 0, text).otherwise(
            F.array_join(F.transform(ws, lambda w, i: cased(w, i, F.size(ws) - 1)), " ")
        ),
    )


def title_case_tagged(text: Column, small_words: list[str] | None = None) -> Column:
    """Title case applied to each stretch between tags; the tags stay."""
    def cased(part: Column) -> Column:
        return F.when(part.startswith("[") & part.endswith("]"), part).otherwise(title_case(part, small_words))

    tagged = let(
        matches(text, TAG),
        lambda found: F.array_join(
            F.transform(
                F.split(text, TAG, -1),
                lambda part, i: F.concat(cased(part), F.coalesce(F.get(found, i), F.lit(""))),
            ),
            "",
        ),
    )
    return F.when(text.contains("["), tagged).otherwise(title_case(text, small_words))


def whole_word(phrase: str) -> str:
    """Java pattern for ``phrase`` between word boundaries, ignoring case."""
    return rf"(?iU)\b{re.escape(phrase)}\b"


def any_phrase(phrases: list[str]) -> str:
    """One alternation over all phrases, in the given order, tried where a phrase's first character stands."""
    firsts = "".join(sorted({re.escape(p[0]) for p in phrases})) if phrases and all(phrases) else ""
    ahead = f"(?=[{firsts}])" if firsts else ""
    return rf"(?iU){ahead}\b(?:{'|'.join(map(re.escape, phrases))})\b"


def replace_banned(text: Column, banned: dict[str, str] | None = None) -> Column:
    """Write the suggested wording instead of each banned phrase.

    A match in capitals stays in capitals and one in title case is capitalised.
    Texts without any banned phrase pass one combined pattern and no more.
    """
    banned = rules.BANNED_PHRASES if banned is None else banned
    if not banned:
        return text

    def rewrite(s: Column, phrase: str, wanted: str) -> Column:
        return splice(
            s,
            whole_word(phrase),
            lambda hit, _: F.when(hit == phrase.upper(), wanted.upper())
            .when(hit == phrase.title(), wanted.capitalize())
            .when(hit.isNotNull(), wanted),
        )

    def fold(s: Column, rest: list[tuple[str, str]]) -> Column:
        if not rest:
            return s
        (phrase, wanted), tail = rest[0], rest[1:]
        return let(rewrite(s, phrase, wanted), lambda done: fold(done, tail))

    return F.when(text.rlike(any_phrase(list(banned))), fold(text, list(banned.items()))).otherwise(text)


def normalize_block(text: Column, kind: Column | None = None, banned: dict[str, str] | None = None) -> Column:
    """Punctuation, phrases, then the rule of the segment's kind; blanks pass."""
    kind = classify_segment_kind(text) if kind is None else F.coalesce(kind, classify_segment_kind(text))
    styled = let(
        F.struct(kind.alias("kind"), let(normalize_punctuation(text), lambda s: replace_banned(s, banned)).alias("s")),
        lambda t: F.when(t["kind"] == "title", title_case_tagged(t["s"])).when(t["kind"] == "bullet", bullet_fragment(t["s"])).otherwise(t["s"]),
    )
    return F.when(is_nonblank(text), collapse_whitespace(styled)).otherwise(text)


def normalize_batch(text: Column) -> Column:
    """Mechanics for titles, mechanics and bullet ending for everything else."""
    return let(
        normalize_mechanics(text),
        lambda s: F.when(classify_segment_kind(text) == "title", s).otherwise(bullet_fragment(s, wide=True)),
    )


def quoted(text: Column) -> Column:
    """``text`` as a pattern that matches it literally, whatever it holds."""
    return F.regexp_replace(text, r"(?U)(\W)", r"\\$1")
