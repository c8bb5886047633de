"""Quality rules by distribution divergence: a text's histograms against those of its language.

Two histograms are compared: kinds of characters, and the most common words of the
language. A reference is the sum of the histograms of all texts of the language that
pass the base rules, so it covers the whole corpus and behaves alike at every size.
Every value of ``lang`` has its own reference; only texts without one share theirs.
Short texts have noisy histograms; the distance allowed grows as the text shrinks,
and below ``min_words`` words the word histogram is not judged at all.

Everything is a built-in expression inside one scan; no Python runs on executors.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.llm.tables import staged, staged_texts, text_of
from twinscript.operators.joins import join_hot

# Frequent function words by language. Any other language has those that stand in most of
# its texts; texts without a language use the pooled list.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "que"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se"],
}
POOLED_WORDS = ["the", "de", "der", "la", "and", "und", "et", "y", "in", "en"]
WORD_SLOTS = 10

SYMBOLS = "#*$%&|<>"
MARKS = "0-9.,;:!?()'\"-"
CHAR_KINDS = ["lower", "upper", "mark", "space", "symbol", "wide"]


@dataclass(frozen=True)
class Limits:
    """Production thresholds. Distances are Jensen-Shannon distances in bits, 0 to 1."""

    min_words: int = 50
    repeat_percent: int = 50
    first_distance: float = 0.2
    char_distance: float = 0.15
    word_distance: float = 0.4
    word_min_words: int = 200
    noise: float = 1.0


def _covered(sorted_positions: Column, width: int) -> Column:
    """Words inside windows of ``width`` that start at these ascending positions."""
    steps = F.zip_with(
        F.slice(sorted_positions, 2, F.greatest(F.size(sorted_positions) - 1, F.lit(0))),
        F.slice(sorted_positions, 1, F.greatest(F.size(sorted_positions) - 1, F.lit(0))),
        lambda b, a: F.least(F.lit(width).cast("long"), b - a),
    )
    return F.when(F.size(sorted_positions) == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(steps, F.lit(width).cast("long"), lambda acc, x: acc + x)
    )


def _count(kind: str) -> Column:
    return F.regexp_count("_t", F.lit(f"[{kind}]")).cast("long")


def _language() -> Column:
    return F.coalesce(F.lower("lang"), F.lit(""))


def common_words(docs: DataFrame) -> DataFrame | None:
    """``_lang`` and its ``_listed`` words, those in most texts, for languages without a fixed list; None without such a language."""
    other = docs.select(_language().alias("_lang"), text_of().alias("_t")).filter(~F.col("_lang").isin("", *COMMON_WORDS))
    if other.select("_lang").isEmpty():
        return None
    words = F.array_remove(F.array_distinct(F.split("_t", "[\\x20\\x09-\\x0D]+")), "")
    counts = other.select("_lang", F.explode(words).alias("_word")).groupBy("_lang", "_word").count()
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("count"), "_word"))
    ranked = counts.withColumn("_rank", rank).filter(F.col("_rank") <= WORD_SLOTS)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_word"))), lambda x: x["_word"])
    listed = F.concat(listed, F.array_repeat(F.lit(""), F.lit(WORD_SLOTS) - F.count("*").cast("int")))  # no word is empty
    return staged(ranked.groupBy("_lang").agg(listed.alias("_listed")), "quality-words")


def measures(docs: DataFrame, keep: list[str], words: DataFrame | None = None) -> DataFrame:
    """Base figures and histograms of every row, besides the columns of ``keep``; ``words`` is from :func:`common_words`.

    Later columns refer to earlier ones by name, several times each, so that the optimizer
    computes an array once instead of copying its expression into every lambda.
    """
    longs = "array<bigint>"
    df = docs.select(*keep, text_of().alias("_t"), _language().alias("_lang"))
    if words is not None:
        # Staged, so its size is known before the join: a table of a few languages is sent to all tasks.
        df = join_hot(df, words, "_lang", "left")
    # Every space character becomes one blank, so the pieces also count the space characters.
    df = df.withColumn("_pieces", F.split(F.regexp_replace("_t", "[\\x09-\\x0D]", " "), " "))
    df = df.withColumn("_w", F.array_remove("_pieces", ""))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    last = (F.size("_w") - 3).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.col("_w")[i], F.col("_w")[i + 1], F.col("_w")[i + 2]))
    df = df.withColumn("_h", F.when(last >= 0, hashes).otherwise(F.array().cast(longs)))
    # A window's hash above, its position below: one sort of plain numbers brings equal windows together.
    bits = F.ceil(F.log2(F.size("_h") + 1.0)).cast("int")
    df = df.withColumn("_bits", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), bits))
    df = df.withColumn("_low", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1)
    packed = F.transform("_h", lambda h, i: (h - h.bitwiseAND(F.col("_low"))).bitwiseOR(i.cast("long")))
    df = df.withColumn("_s", F.when(F.col("_bits").isNotNull(), F.sort_array(packed)).otherwise(F.array().cast(longs)))
    same = F.zip_with(
        F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0))),
        F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))),
        lambda a, b: F.when(a.bitwiseXOR(b).between(F.lit(0), F.col("_low")), F.array(a.bitwiseAND(F.col("_low")), b.bitwiseAND(F.col("_low")))),
    )
    df = df.withColumn("_p", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    df = df.select(
        *keep,
        "_lang",
        "_w",
        *([] if words is None else ["_listed"]),
        F.size("_w").cast("long").alias("_n_words"),
        F.length("_t").cast("long").alias("_n_chars"),
        (F.size("_pieces") - 1).cast("long").alias("_space"),
        (F.octet_length("_t") - F.length("_t")).cast("long").alias("_wide"),
        _count(SYMBOLS).alias("_n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        _covered(F.col("_p"), 3).alias("_n_repeat_words"),
        _count("A-Z").alias("_upper"),
        _count(MARKS).alias("_mark"),
    )
    common = F.lit(None).cast("array<string>") if words is None else F.col("_listed")
    for lang, fixed in COMMON_WORDS.items():
        common = F.when(F.col("_lang") == lang, F.array(*map(F.lit, fixed))).otherwise(common)
    df = df.withColumn("_common", F.coalesce(common, F.array(*map(F.lit, POOLED_WORDS))))
    # A plain function instead of a lambda on every word; a listed word stands in its list once.
    counted = [F.col("_n_words") - F.size(F.array_remove("_w", F.col("_common")[i])) for i in range(WORD_SLOTS)]
    df = df.withColumn("_counted", F.array(*counted))
    rest = F.col("_n_words") - F.aggregate("_counted", F.lit(0).cast("long"), lambda acc, x: acc + x)
    word_chars = F.col("_n_chars") - F.col("_space")
    lower = F.greatest(F.lit(0), word_chars - F.col("_upper") - F.col("_mark") - F.col("_n_symbols"))
    return df.select(
        *keep,
        "_lang",
        "_n_words", word_chars.alias("_word_chars"), "_n_symbols", "_n_dup_lines", "_n_repeat_words",
        F.array(lower, F.col("_upper"), F.col("_mark"), F.col("_space"), F.col("_n_symbols"), F.col("_wide")).alias("_kinds"),
        F.concat("_counted", F.array(rest)).alias("_common"),
    )


def base_failed(limits: Limits) -> Column:
    return (F.col("_n_words") < limits.min_words) | (100 * F.col("_n_repeat_words") > limits.repeat_percent * F.col("_n_words"))


def _summed(measured: DataFrame) -> DataFrame:
    """Histograms added up by language, one row for each and one for all texts without a language."""
    sums = [F.sum(F.col("_kinds")[i]).alias(f"k{i}") for i in range(len(CHAR_KINDS))]
    sums += [F.sum(F.col("_common")[i]).alias(f"c{i}") for i in range(WORD_SLOTS + 1)]
    return measured.groupBy("_lang").agg(*sums).select(
        F.col("_lang").alias("_ref_lang"),
        F.array(*[f"k{i}" for i in range(len(CHAR_KINDS))]).alias("_ref_kinds"),
        F.array(*[f"c{i}" for i in range(WORD_SLOTS + 1)]).alias("_ref_common"),
    )


def references(measured: DataFrame, limits: Limits) -> DataFrame:
    """Reference histograms of each language, from ``measured``, which is read twice and should be staged.

    A first sum takes all texts that pass the base rules. Odd texts among them pull it their way,
    so a second one takes only those nearer to the first than ``first_distance``.
    """
    sound = measured.filter(~base_failed(limits))
    first = _with_reference(sound, staged(_summed(sound), "quality-first"), "inner")
    near = jensen_shannon(F.col("_kinds"), F.col("_ref_kinds")) <= limits.first_distance
    return staged(_summed(first.filter(near).select("_lang", "_kinds", "_common")), "quality-reference")


def _with_reference(measured: DataFrame, reference: DataFrame, how: str) -> DataFrame:
    return join_hot(measured, reference.withColumnRenamed("_ref_lang", "_lang"), "_lang", how)


def jensen_shannon(counts: Column, reference: Column) -> Column:
    """Distance of two histograms of counts: the root of their divergence in bits. Empty ones have none (null)."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda a: F.transform(a, lambda x: x / total(a))
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    terms = F.zip_with(share(counts), share(reference), lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2)
    return F.when((total(counts) > 0) & (total(reference) > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms))))


def judged(measured: DataFrame, reference: DataFrame, limits: Limits) -> DataFrame:
    """Add ``_char_distance``, ``_word_distance``, ``_base_failed`` and ``_kept``."""
    df = _with_reference(measured, reference, "left")
    slack = limits.noise / F.sqrt(F.greatest(F.col("_n_words"), F.lit(1)))
    df = df.withColumns(
        {
            "_char_distance": jensen_shannon(F.col("_kinds"), F.col("_ref_kinds")),
            "_word_distance": jensen_shannon(F.col("_common"), F.col("_ref_common")),
            "_base_failed": base_failed(limits),
        }
    )
    odd = (F.coalesce("_char_distance", F.lit(0.0)) > limits.char_distance + slack / 4) | (
        (F.col("_n_words") >= limits.word_min_words) & (F.coalesce("_word_distance", F.lit(0.0)) > limits.word_distance + slack / 2)
    )
    return df.withColumn("_kept", ~F.col("_base_failed") & ~odd)


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Base figures, distances and the verdict for every document.

    A null text counts as empty: no words, so the base rules reject it. Every language is held
    against its own texts, those without a language against each other. Repeated rows give repeated
    rows; an empty table gives an empty one. Columns besides doc_id, text and lang are not read.
    """
    measured = staged(measures(docs, ["doc_id"], common_words(docs)), "quality")
    rows = judged(measured, references(measured, limits), limits)
    return rows.select(
        "doc_id",
        *[F.col(f"_{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        *[F.col(f"_{n}").alias(n) for n in ("base_failed", "kept")],
        F.col("_char_distance").alias("char_distance"),
        F.col("_word_distance").alias("word_distance"),
    )


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns."""
    # Rows go with their figures, so texts are measured once. Written down before it is filtered: a filter on the
    # verdict would be moved below the projections that lead to it, and every array would be computed once for each
    # of its uses. The references read the figures' columns alone.
    inner = docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang")
    measured = staged_texts(measures(inner, ["_row"], common_words(docs)), "quality")
    return judged(measured, references(measured, limits), limits).filter("_kept").select("_row.*")


def quality_sql(limits: Limits = Limits()) -> str:
    """The same rules for the check."""
    common = " ".join(f"WHEN '{lang}' THEN {words!r}" for lang, words in COMMON_WORDS.items())
    langs = ", ".join(f"'{x}'" for x in COMMON_WORDS)
    kinds, slots = len(CHAR_KINDS), WORD_SLOTS + 1
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i}])" for i in range(1, n + 1)) + "]"

    def distance(a: str, b: str, n: int) -> str:
        p = [f"({a}[{i}] / list_sum({a})::DOUBLE)" for i in range(1, n + 1)]
        q = [f"({b}[{i}] / list_sum({b})::DOUBLE)" for i in range(1, n + 1)]
        part = lambda x, m: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) ELSE 0 END"
        terms = " + ".join(f"({part(x, f'(({x} + {y}) / 2)')} + {part(y, f'(({x} + {y}) / 2)')}) / 2" for x, y in zip(p, q))
        return f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(0, {terms})) END"

    failed = f"(n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words)"
    space = "[\\x20\\x09-\\x0D]"
    return f"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lower(lang), '') AS lang,
    list_filter(string_split_regex(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM rows)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i) AS n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS i FROM twice) GROUP BY rid),
counted AS (SELECT rows.rid, doc_id, w, CASE WHEN lang IN ({langs}) THEN lang ELSE '' END AS lang, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '{space}+', '', 'g'))::BIGINT AS word_chars, length(t)::BIGINT AS n_chars, (strlen(t) - length(t))::BIGINT AS wide,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS upper_, (length(t) - length(translate(t, '0123456789.,;:!?()''"-', '')))::BIGINT AS mark,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, CASE lang {common} ELSE {POOLED_WORDS!r} END AS common
    FROM rows LEFT JOIN covered ON rows.rid = covered.rid),
hits AS (SELECT *, list_transform(common, lambda c: len(list_filter(w, lambda x: x = c))) AS found FROM counted),
measured AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    [greatest(0, word_chars - upper_ - mark - n_symbols), upper_, mark, n_chars - word_chars, n_symbols, wide] AS kinds,
    list_concat(found, [len(w) - list_sum(found)]) AS words, {failed} AS base_failed FROM hits),
first AS (SELECT lang, {sums("kinds", kinds)} AS rk FROM measured WHERE NOT base_failed GROUP BY lang),
near AS (SELECT m.* FROM measured m JOIN first f ON m.lang = f.lang WHERE NOT base_failed AND {distance("kinds", "rk", kinds)} <= {limits.first_distance}),
refs AS (SELECT lang, {sums("kinds", kinds)} AS rk, {sums("words", slots)} AS rw FROM near GROUP BY lang),
judged AS (SELECT m.*, {limits.noise} / sqrt(greatest(n_words, 1)) AS slack, {distance("kinds", "rk", kinds)} AS dk, {distance("words", "rw", slots)} AS dw
    FROM measured m LEFT JOIN refs r ON m.lang = r.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (
    coalesce(dk, 0) > {limits.char_distance} + slack / 4 OR (n_words >= {limits.word_min_words} AND coalesce(dw, 0) > {limits.word_distance} + slack / 2)) AS kept
FROM judged
"""
