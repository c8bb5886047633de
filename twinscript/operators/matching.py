"""Matching texts against rule tables (glossary, phrases, marks, alternatives).

A rule table up to ``INLINE_RULES`` rows becomes literal conditions in one
projection: no join and no shuffle. A larger one is met by an equi join on a part
of each term (a few characters, or a word when whole words are asked for) that
few other terms have, and every candidate is then checked in full.

The rows do not depend on the way taken. Before any way is chosen, rules without a
term are dropped, and rules are put in one total order: by ``place`` (a missing one
counts as 0), then by their text in code-point order. An empty term is contained
in every text, and as a whole word in none. Rows are told apart by themselves,
never by a caller's keys, which may repeat or be null.
"""

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from twinscript import rules
from twinscript.functions.casing import any_phrase, quoted, whole_word
from twinscript.functions.text import let, preview, strip_tags
from twinscript.operators.joins import join_hot
from twinscript.session import small_table, staged

INLINE_RULES = 256
GRAMS = (16, 8, 4, 3, 2, 1, 0)
BROADCAST_RULES = 200_000
BROADCAST_CHARS = 16_000_000
BROADCAST_HASHES = 4_000_000  # of eight bytes
FIRST_CHARS = 500  # that a pattern lists; any more and grams may start anywhere


def bounded_rows(table: DataFrame, limit: int = INLINE_RULES) -> list[Row] | None:
    """The rows of a table, or None when there are more than ``limit`` of them."""
    rows = table.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def usable_rules(table: DataFrame, *columns: str, word: str | None = None) -> DataFrame:
    """The rules that have a value in all ``columns``, and text in ``word``."""
    for c in columns:
        table = table.filter(F.col(c).isNotNull())
    return table.filter(F.col(word) != "") if word else table


def with_places(table: DataFrame) -> DataFrame:
    """``table`` with ``place``; a rule without one comes first."""
    place = F.col("place") if "place" in table.columns else F.lit(None)
    return table.withColumn("place", F.coalesce(place.cast("int"), F.lit(0)))


def _identity(*columns: Column) -> Column:
    """128 bits that stand for the values: rows alike in them get the same answer."""
    values = [x for c in columns for x in (c, c.isNull())]
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b"))


# Letters whose lower case is their own but which a pattern that ignores case
# takes for another letter, and those letters.
LOOKALIKES = ("ſςıµϐϑϕϖϰϱϵẛ", "sσiμβθφπκρεṡ")


def _folded(text: Column) -> Column:
    """One form for all spellings that differ in case only. Most texts hold no such letter, and none of theirs is looked up."""
    dotless = F.when(text.contains("İ"), F.translate(text, "İ", "i")).otherwise(text)
    return let(F.lower(dotless), lambda t: F.when(t.rlike(f"[{LOOKALIKES[0]}]"), F.translate(t, *LOOKALIKES)).otherwise(t))


def _words(text: Column, first: str = ".") -> Column:
    """The words of a text (that begin with a character of ``first``), folded."""
    begins = r"\w+" if first == "." else rf"{first}(?<!\w.)\w*"
    return F.regexp_extract_all(_folded(text), F.lit(f"(?Us){begins}"), F.lit(0))


def _gram_pattern(n: Column, first: str = ".") -> Column:
    """Every position (with a character of ``first``) starts a gram: the lookahead matches without moving on."""
    rest = F.concat(F.lit(f"(?s)(?=({first}.{{"), (n - 1).cast("string"), F.lit("}))"))
    return F.when(n > 0, rest).otherwise("(?=())")


def _gram_size(term: Column) -> Column:
    """The largest gram size that fits the term."""
    size = F.lit(None).cast("int")
    for n in sorted(GRAMS):
        size = F.when(F.length(term) >= n, F.lit(n)).otherwise(size)
    return size


def _rarest_key(table: DataFrame, term: Column, candidates: Column) -> DataFrame:
    """Add ``_key``: the candidate that fewest terms of the table share, null without any; and ``_rule``, a row's number.

    Terms often begin or end alike. A key they share would pair each of its texts
    with each of its terms; the rarest one keeps them apart.
    """
    terms = table.select(term.alias("_t")).distinct()
    keys = terms.select("_t", F.explode(candidates).alias("_k"))
    shared = keys.groupBy("_k").agg(F.count("*").alias("_n"))
    rarest = (
        keys.join(shared, "_k")
        .groupBy("_t")
        .agg(F.min(F.struct("_n", (-F.length("_k")).alias("_short"), "_k")).alias("_best"))
        .select("_t", F.col("_best._k").alias("_key"))
    )
    keyed = table.withColumn("_t", term).join(rarest, "_t", "left").drop("_t")
    # Read several times from here on: measured, cut by its key sizes, and joined.
    return staged(keyed.withColumn("_rule", F.monotonically_increasing_id()), "rules")


def _measure(keyed: DataFrame) -> Row:
    """Rows and characters of a rule table: one small row, whatever the table holds."""
    chars = sum(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in keyed.columns)
    return keyed.agg(F.count("*").alias("n"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars")).first()


def _firsts() -> Column:
    """The characters that keys begin with, one more than a pattern lists if they are too many."""
    return F.slice(F.array_sort(F.collect_set(F.substring("_key", 1, 1))), 1, FIRST_CHARS + 1).alias("first")


def _class(chars: list[str]) -> str:
    """The characters as a pattern's class, any character if they are none or too many."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]" if chars and all(chars) and len(chars) <= FIRST_CHARS else "."


def _cuts(keyed: DataFrame) -> list[tuple[int, str]]:
    """The gram sizes of the keys with the characters these begin with, as a class, if they are not too many."""
    rows = keyed.groupBy(F.length("_key").alias("size")).agg(_firsts()).collect()
    return sorted((r["size"], _class(r["first"])) for r in rows)


def _meet(df: DataFrame, text: Column, keys: Callable[[Column], Column], keyed: DataFrame, broadcast: int) -> DataFrame:
    """Rows of ``df`` with the rules of which ``keys(text)`` holds the key.

    The rules are measured. Below the bounds they are broadcast, and a text is held
    against them where it is read. Beyond, only hashes are shuffled: of a text and of
    its keys, met with those of the rules; the text is joined to what is left of it.
    A false match of hashes makes a candidate like any other, for the caller to check.
    """
    size = _measure(keyed)
    if size["n"] <= broadcast and size["chars"] <= BROADCAST_CHARS:
        return df.withColumn("_key", F.explode(keys(text))).join(F.broadcast(keyed), "_key").drop("_key", "_rule")
    hashed = df.select(F.xxhash64(text).alias("_text_id"), F.transform(keys(text), lambda k: F.xxhash64(k)).alias("_keys"))
    found = hashed.select("_text_id", F.explode("_keys").alias("_h"))
    of_rules = keyed.select(F.xxhash64("_key").alias("_h"), "_rule")
    if size["n"] <= BROADCAST_HASHES:
        # Most parts of a text are no rule's key and go before anything is shuffled.
        found = found.join(F.broadcast(of_rules.select("_h").distinct()), "_h", "left_semi")
    met = found.join(of_rules.hint("merge"), "_h").select("_text_id", "_rule").distinct()
    candidates = met.join(keyed.drop("_key"), "_rule").drop("_rule")
    return join_hot(df.withColumn("_text_id", F.xxhash64(text)), candidates, "_text_id").drop("_text_id")


def _pairs_by_gram(df: DataFrame, text: Column, table: DataFrame, term: Column, broadcast: int = BROADCAST_RULES) -> DataFrame:
    """Rows paired with the rules of which a gram occurs in ``text``; each pair appears once.

    Texts are cut into grams of only those sizes the rules use, at places where a key may begin.
    """
    grams = F.array_distinct(
        F.regexp_extract_all(F.col("_t"), _gram_pattern(_gram_size(F.col("_t"))), F.lit(1))
    )
    keyed = _rarest_key(table, term, grams).filter(F.col("_key").isNotNull())
    cuts = _cuts(keyed)

    def keys(value: Column) -> Column:
        parts = [F.regexp_extract_all(value, _gram_pattern(F.lit(n), first), F.lit(1)) for n, first in cuts]
        return F.array_distinct(F.concat(F.array().cast("array<string>"), *parts))

    return _meet(df, text, keys, keyed, broadcast)


def _pairs_by_word(df: DataFrame, text: Column, table: DataFrame, term: Column, broadcast: int = BROADCAST_RULES) -> DataFrame:
    """Rows paired with the rules of which a word is a word of ``text``."""
    keyed = _rarest_key(table, term, F.array_distinct(_words(F.col("_t"))))
    first = _class(keyed.agg(_firsts()).first()["first"])
    worded = _meet(df, text, lambda value: F.array_distinct(_words(value, first)), keyed.filter(F.col("_key").isNotNull()), broadcast)
    # A rule without any word in it can only be met by its characters.
    without = keyed.filter(F.col("_key").isNull()).drop("_key", "_rule")
    if without.isEmpty():
        return worded
    return worded.unionByName(_pairs_by_gram(df, text, without, term, broadcast))


def match_rules(
    df: DataFrame,
    text: Column,
    table: DataFrame,
    term: str,
    ignore_case: bool = False,
    word: bool = False,
    inline: int = INLINE_RULES,
    broadcast: int = BROADCAST_RULES,
) -> DataFrame:
    """One row per (row of ``df``, rule whose ``term`` occurs in ``text``), with the rule's columns.

    ``word`` asks for a whole word and ignores case; otherwise containment. Null
    texts and null terms match nothing; an empty term is contained in every text
    and is no word. Repeated rows and repeated rules each give their own rows.
    ``inline`` and ``broadcast`` bound the ways, not the result.
    """
    columns = table.columns
    table = usable_rules(table, term, word=term if word else None)
    small = bounded_rows(table, inline)
    if small is not None:
        def condition(value: str) -> Column:
            if word:
                return text.rlike(whole_word(value))
            return F.contains(F.lower(text), F.lower(F.lit(value))) if ignore_case else text.contains(value)

        types = {f.name: f.dataType for f in table.schema}
        found = [
            F.when(
                condition(r[term]), F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in columns])
            )
            for r in small
        ]
        if not found:
            return df.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in columns]).filter(F.lit(False))
        if word:
            df = df.filter(text.rlike(any_phrase([r[term] for r in small])))
        return df.withColumn("_hit", F.explode(F.array_compact(F.array(*found)))).select(
            *df.columns, *[F.col(f"_hit.{c}").alias(c) for c in columns]
        )

    raw = df.withColumn("_text", text if word or not ignore_case else F.lower(text)).filter(F.col("_text").isNotNull())
    if word:
        pairs = _pairs_by_word(raw, F.col("_text"), table, F.col(term), broadcast)
        return pairs.filter(
            F.call_function("rlike", F.col("_text"), F.concat(F.lit(r"(?iU)\b"), quoted(F.col(term)), F.lit(r"\b")))
        ).drop("_text")
    wanted = table.withColumn("_term", F.lower(term) if ignore_case else F.col(term))
    pairs = _pairs_by_gram(raw, F.col("_text"), wanted, F.col("_term"), broadcast)
    return pairs.filter(F.col("_text").contains(F.col("_term"))).drop("_text", "_term")


def glossary_hits(bilingual: DataFrame, glossary: DataFrame, **kw) -> DataFrame:
    """Pairs of a row and a term its source contains."""
    return match_rules(bilingual, F.col("src"), glossary, "term", **kw)


def glossary_missing(bilingual: DataFrame, glossary: DataFrame, **kw) -> DataFrame:
    """Hits whose target lacks the expected rendering."""
    return glossary_hits(bilingual, glossary, **kw).filter(~F.col("tgt").contains(F.col("expected")))


def listed_alternatives(glossary: DataFrame, alternatives: DataFrame) -> DataFrame:
    """The glossary's terms with their alternatives: ``term, expected, alt, place``."""
    known = usable_rules(glossary, "term", "expected")
    return known.join(with_places(usable_rules(alternatives, "alt")), "term").select("term", "expected", "alt", "place")


def alternative_hits(bare: Column, listed: list[Row]) -> Column:
    """``array<struct(term, expected, found)>`` for a text without tags in lower case.

    A term counts when one of its alternatives occurs and the expected rendering
    does not; its first alternative by place, then by text, is named.
    """
    by_term: dict[tuple[str, str], list[str]] = {}
    for r in sorted(listed, key=lambda r: (r["term"], r["place"], r["alt"])):
        by_term.setdefault((r["term"], r["expected"]), []).append(r["alt"])
    holds = lambda part: F.contains(bare, F.lower(F.lit(part)))

    def hit(term: str, expected: str, alts: list[str]) -> Column:
        first = F.coalesce(*[F.when(holds(alt), F.lit(alt)) for alt in alts])
        return F.when(
            first.isNotNull() & ~holds(expected),
            F.struct(F.lit(term).alias("term"), F.lit(expected).alias("expected"), first.alias("found")),
        )

    none = F.array().cast("array<struct<term:string,expected:string,found:string>>")
    if not by_term:
        return none
    return F.array_compact(F.array(*[hit(t, e, alts) for (t, e), alts in by_term.items()]))


def _answered(rows: DataFrame, answers: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """``rows`` with the answers (``_of`` and more) of their identity ``by``, however often it occurs."""
    return join_hot(rows.withColumn("_of", by), answers, "_of", how).drop("_of")


def glossary_alternatives(
    bilingual: DataFrame, glossary: DataFrame, alternatives: DataFrame, keys: list[str], text: str = "tgt",
    inline: int = INLINE_RULES, broadcast: int = BROADCAST_RULES,
) -> DataFrame:
    """Targets that use a listed alternative while the expected term is absent.

    ``alternatives`` has ``term, alt`` and maybe ``place``; the lowest place, then the
    first text, wins per row and term. ``keys`` are the columns to keep; they need not
    tell rows apart. Null targets, terms, renderings and alternatives give nothing; an
    empty alternative is in every text, and an empty rendering is never absent.
    """
    listed = listed_alternatives(glossary, alternatives)
    rows = bilingual.withColumn("_bare", F.lower(strip_tags(F.col(text))))
    context = preview(F.col(text), 50, always=True)
    small = bounded_rows(listed, inline)
    if small is not None:
        return rows.withColumn("_hit", F.explode(alternative_hits(F.col("_bare"), small))).select(
            *keys, "_hit.term", "_hit.expected", "_hit.found", context.alias("context")
        )
    # A row's hits meet again by all that the result shows of the row and by its text, so the rows are read once.
    # Rows alike in that are as many in each hit; every one of them gets its own answer.
    shown = rows.select(F.struct(*keys, context.alias("_context")).alias("_row"), "_bare", _identity(F.col("_bare")).alias("_of"))
    pairs = match_rules(shown, F.col("_bare"), listed.distinct(), "alt", ignore_case=True, inline=inline, broadcast=broadcast)
    first = (
        pairs.filter(~F.col("_bare").contains(F.lower("expected")))
        .groupBy("_row", "_of", "term", "expected")
        .agg(F.collect_set(F.struct("place", "alt")).alias("_found"), F.count("*").alias("_n"))
        .withColumn("_same", F.explode(F.array_repeat(F.array_min("_found"), (F.col("_n") / F.size("_found")).cast("int"))))
    )
    return first.select(
        *[F.col("_row")[k].alias(k) for k in keys], "term", "expected", F.col("_same.alt").alias("found"), F.col("_row._context").alias("context")
    )


def term_usage(bilingual: DataFrame, glossary: DataFrame, **kw) -> DataFrame:
    """Rows whose target uses the expected rendering of a term, ignoring case."""
    bare = bilingual.withColumn("context", F.lower(strip_tags(F.col("tgt"))))
    return match_rules(bare, F.col("context"), glossary, "expected", ignore_case=True, **kw).select(
        "deck_id", "slide", "idx", "term", F.col("expected").alias("usage"), "context"
    )


def term_variant_uses(bilingual: DataFrame, glossary: DataFrame, alternatives: DataFrame, **kw) -> DataFrame:
    """One row per place and rendering: the expected one or a listed alternative."""
    glossary = usable_rules(glossary, "term")
    renderings = glossary.select("term", F.col("expected").alias("variant")).unionByName(
        glossary.join(alternatives, "term").select("term", F.col("alt").alias("variant"))
    ).distinct()
    bare = bilingual.withColumn("_bare", F.lower(strip_tags(F.col("tgt"))))
    return match_rules(bare, F.col("_bare"), renderings, "variant", ignore_case=True, **kw).select(
        "deck_id", "slide", "idx", "term", "variant"
    )


def _several(renderings: DataFrame) -> DataFrame:
    return renderings.groupBy("deck_id", "term").agg(F.count("*").alias("n_variants")).filter("n_variants > 1")


def inconsistent_terms(uses: DataFrame) -> DataFrame:
    """Deck and term with the number of renderings, where that is more than one."""
    return _several(uses.groupBy("deck_id", "term", "variant").agg(F.count("*").alias("n_uses")))


def term_variants(uses: DataFrame) -> DataFrame:
    """Terms a deck renders in more than one way: one row per rendering.

    A rendering may occur anywhere any number of times, so it is counted and its
    first place is given; :func:`term_variant_places` lists them all.
    """
    counted = uses.groupBy("deck_id", "term", "variant").agg(
        F.count("*").alias("n_uses"), F.min(F.struct("slide", "idx")).alias("at")
    )
    several = _several(counted)
    return counted.join(several, ["deck_id", "term"]).select(
        "deck_id", "term", "variant", "n_variants", "n_uses",
        F.col("at.slide").alias("first_slide"), F.col("at.idx").alias("first_idx"),
    )


def term_variant_places(uses: DataFrame) -> DataFrame:
    """Every place of every term with several renderings in its deck."""
    several = term_variants(uses).select("deck_id", "term", "variant", "n_variants")
    return uses.join(several, ["deck_id", "term", "variant"])


def banned_phrase_flags(df: DataFrame, banned: DataFrame, text: str = "text", **kw) -> DataFrame:
    """One row per text and phrase that stands in it as a whole word."""
    bare = df.withColumn("_bare", strip_tags(F.col(text)))
    return (
        match_rules(bare, F.col("_bare"), banned, "phrase", word=True, **kw)
        .withColumn("context", preview(F.col("_bare"), 80, always=True))
        .drop("_bare")
    )


def _in_order(banned: Iterable) -> list:
    """Phrase rules by place, then phrase, then suggestion (none first)."""
    return sorted(banned, key=lambda r: (r["place"], r["phrase"], r["suggested"] is not None, r["suggested"] or ""))


def banned_matches(text: Column, banned: dict[str, str] | list) -> Column:
    """``array<struct(word, suggested)>``: every match of one combined pattern, left to right.

    Where several phrases match at one place the first in order wins. Of phrases that
    differ in case only the last one's suggestion counts, as in a dictionary by lower case.
    """
    if isinstance(banned, dict):
        banned = [{"place": i, "phrase": k, "suggested": v, "low": k.lower()} for i, (k, v) in enumerate(banned.items())]
    hits = F.regexp_extract_all(text, F.lit(any_phrase([r["phrase"] for r in banned])), F.lit(0))
    by_word = {r["low"]: r["suggested"] for r in banned}
    suggestion = F.create_map(*[F.lit(x).cast("string") for entry in by_word.items() for x in entry])
    return F.transform(
        hits,
        lambda m: F.struct(
            m.alias("word"), F.coalesce(F.try_element_at(suggestion, F.lower(m)), F.lit("review")).alias("suggested")
        ),
    )


def _matches_of_found(text: Column, found: Column) -> Column:
    """What ``banned_matches`` gives, from the phrases that stand in the text, in order.

    A phrase that does not stand in the text takes no part in its pattern, so the
    matches are those of the pattern of all phrases.
    """
    each = F.transform(found, lambda f: F.concat(F.lit(r"\b"), quoted(f["phrase"]), F.lit(r"\b")))
    hits = F.regexp_extract_all(text, F.concat(F.lit("(?iU)"), F.array_join(each, "|")), F.lit(0))

    def suggested(word: Column) -> Column:
        same = F.filter(found, lambda f: F.lower(f["phrase"]) == F.lower(word))
        return F.coalesce(F.try_element_at(same, F.lit(-1))["suggested"], F.lit("review"))

    return F.transform(hits, lambda m: F.struct(m.alias("word"), suggested(m).alias("suggested")))


def banned_word_matches(
    bilingual: DataFrame, banned: DataFrame, keys: list[str] | None = None, inline: int = INLINE_RULES, broadcast: int = BROADCAST_RULES
) -> DataFrame:
    """One row per match with its suggestion (``review`` without one).

    Matches of a text do not overlap: from left to right, the first phrase in order
    (``place``, then phrase) that stands at a place takes it. ``keys`` are the columns
    to keep; they need not tell rows apart. Null texts and null or empty phrases give
    nothing.
    """
    keys = ["deck_id", "slide", "idx"] if keys is None else keys
    ordered = with_places(usable_rules(banned, "phrase", word="phrase")).select("place", "phrase", "suggested", F.lower("phrase").alias("low"))
    rows = bilingual.select(*keys, strip_tags(F.col("tgt")).alias("_bare"))
    small = bounded_rows(ordered, inline)
    if small is not None:
        if not small:
            rows = rows.filter(F.lit(False))
            small = [{"place": 0, "phrase": "-", "suggested": None, "low": "-"}]
        small = _in_order(small)
        rows = rows.filter(F.col("_bare").rlike(any_phrase([r["phrase"] for r in small])))
        matches = rows.select(*keys, F.explode(banned_matches(F.col("_bare"), small)).alias("_m"), "_bare")
    else:
        bare = rows.select("_bare", _identity(F.col("_bare")).alias("_of"))
        pairs = match_rules(bare, F.col("_bare"), ordered.drop("low"), "phrase", word=True, inline=inline, broadcast=broadcast)
        # As many as there are phrases in the text.
        found = pairs.groupBy("_of").agg(F.array_sort(F.collect_set(F.struct("place", "phrase", "suggested"))).alias("_found"))
        answered = _answered(rows, found, _identity(F.col("_bare")))
        matches = answered.select(*keys, F.explode(_matches_of_found(F.col("_bare"), F.col("_found"))).alias("_m"), "_bare")
    return matches.select(*keys, "_m.word", "_m.suggested", preview(F.col("_bare"), 60).alias("context"))


def punct_flags(df: DataFrame, marks: DataFrame, text: str = "text", **kw) -> DataFrame:
    """One row per text and source mark left in it; ``marks`` has ``original, correct``."""
    return match_rules(df, F.col(text), marks, "original", **kw).withColumn(
        "context", preview(F.col(text), 50, always=True)
    )


def integrity_of_terms(
    df: DataFrame, glossary: DataFrame, src: Column, combined: Column, keys: list[str] | None = None,
    inline: int = INLINE_RULES, broadcast: int = BROADCAST_RULES,
) -> DataFrame:
    """Add ``terms_kept``: each glossary term of the source has its rendering in ``combined``.

    Every row is judged by itself, whatever ``keys`` it carries. A null source has no
    terms, a null ``combined`` no renderings; rules lacking a side are left out.
    """
    src, combined = F.coalesce(src, F.lit("")), F.coalesce(combined, F.lit(""))
    glossary = usable_rules(glossary, "term", "expected")
    small = bounded_rows(glossary, inline)
    if small is not None:
        kept = F.lit(True)
        for r in small:
            kept = kept & (~src.contains(r["term"]) | combined.contains(r["expected"]))
        return df.withColumn("terms_kept", kept)
    sides = df.select(src.alias("_src"), combined.alias("_all"), _identity(src, combined).alias("_of"))
    lost = (
        match_rules(sides, F.col("_src"), glossary.select("term", "expected"), "term", inline=inline, broadcast=broadcast)
        .filter(~F.col("_all").contains(F.col("expected")))
        .select("_of")
        .distinct()
        .withColumn("_lost", F.lit(True))
    )
    return _answered(df, lost, _identity(src, combined), "left").withColumn("terms_kept", F.col("_lost").isNull()).drop("_lost")


def dict_table(spark, table: dict[str, str], key: str, value: str) -> DataFrame:
    """A rule dictionary as a table with its order in ``place``."""
    rows = [(k, v, i) for i, (k, v) in enumerate(table.items())]
    return small_table(spark, rows, f"{key} string, {value} string, place int")


def alternatives_table(spark, table: dict[str, list[str]] | None = None) -> DataFrame:
    table = rules.ALTERNATIVES if table is None else table
    rows = [(term, alt, i) for term, alts in table.items() for i, alt in enumerate(alts)]
    return small_table(spark, rows, "term string, alt string, place int")
