"""License scans by diagonal voting over word k-gram hashes.

Every text's rolling word k-gram hashes meet the positions of the same grams in the templates.
A hit votes for its diagonal, the text position less the template position; an intact phrase is
one full diagonal, and a longer notice with words put in or left out is a band of neighbouring
ones, which are merged. Hits are verified word by word, spans by how much of the template they hold.

Built-in expressions and joins only; hashes that no template holds are dropped before a row
is made of them, so what is joined and grouped are hits.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscript.llm.tables import content_key, staged, text_of
from twinscript.operators.joins import join_hot
from twinscript.session import small_table

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# The phrases of the base figures with their labels.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

# Other phrases that name a license, and the opening words of common notices.
PHRASES = [
    ("cc", "creative commons attribution"),
    ("cc", "licensed under cc by"),
    ("mpl", "mozilla public license"),
    ("bsd", "bsd license"),
    ("isc", "isc license"),
    ("epl", "eclipse public license"),
]
NOTICES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software",
    ),
    (
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org "
        "licenses license 2 0",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies",
    ),
]
PHRASE_WORDS, NOTICE_WORDS = 2, 4  # of a gram
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MASK_BITS = 62  # template positions told apart by one number


@dataclass(frozen=True)
class Scan:
    coverage: float = 0.6  # of a notice's grams, from which it counts as found
    band: int = 4  # words by which neighbouring diagonals may differ


def templates() -> list[tuple[int, str, str, int, bool]]:
    """(number, label, text, words of a gram, whether it is of the base)."""
    rows = [(label, text, PHRASE_WORDS, True) for label, text in BASE]
    rows += [(label, text, PHRASE_WORDS, False) for label, text in PHRASES]
    rows += [(label, text, NOTICE_WORDS, False) for label, text in NOTICES]
    return [(i, *row) for i, row in enumerate(rows)]


def template_grams() -> list[tuple[int, int, int, str]]:
    """(template, gram words, position, gram) of every template: a few hundred rows, fixed by the lists above."""
    out = []
    for number, _, text, k, _ in templates():
        words = text.split(" ")
        out += [(number, k, i, " ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
    return out


def _gram_hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _template_table(spark: SparkSession) -> DataFrame:
    rows = small_table(spark, template_grams(), "_template int, _k int, _at int, _gram string")
    facts = [(i, label, base, len(text.split(" ")) - k + 1, k) for i, label, text, k, base in templates()]
    return rows.join(F.broadcast(small_table(spark, facts, "_template int, _label string, _base boolean, _grams int, _width int")), "_template")


def _known_hashes(spark: SparkSession) -> dict[int, list[int]]:
    """Hashes of the templates' grams by gram words, computed by the engine that hashes the texts."""
    rows = small_table(spark, template_grams(), "_template int, _k int, _at int, _gram string")
    words = F.split("_gram", " ")
    h = F.when(F.col("_k") == PHRASE_WORDS, _gram_hash([words[i] for i in range(PHRASE_WORDS)]))
    h = h.otherwise(_gram_hash([words[i] for i in range(min(NOTICE_WORDS, 4))]))
    known: dict[int, list[int]] = {}
    for k, x in rows.select("_k", h.alias("h")).distinct().collect():
        known.setdefault(k, []).append(x)
    return known


def _hits(k: int, known: list[int]) -> Column:
    """Places of the text's k-grams whose hash a template holds."""
    last = (F.size("_w") - k).cast("int")
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.when(_gram_hash([F.col("_w")[i + j] for j in range(k)]).isin(*known), i))
    places = F.filter(grams, lambda i: i.isNotNull())
    found = F.transform(places, lambda i: F.struct(i.alias("pos"), F.lit(k).alias("k"), F.array_join(F.slice("_w", i + 1, F.lit(k)), " ").alias("gram")))
    return F.when(last >= 0, found).otherwise(F.array().cast("array<struct<pos:int,k:int,gram:string>>"))


def license_scan(docs: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    ``score`` is the largest part of a template's positions found near each other: one for a whole phrase.
    A position counts once, however often a text repeats it; neighbouring diagonals make a band of no more
    words than the template has. A null text counts as
    empty; texts without a hit have no labels and score zero. Overlapping places all count. Repeated
    rows and null doc_ids stay rows; copies of a text share one result. An empty table gives an empty
    result. Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    known = _known_hashes(spark)
    words = F.array_remove(F.split(F.translate(text_of(), UPPER, UPPER.lower()), NOT_WORD), "")
    rows = docs.select("doc_id", content_key().alias("_key"), words.alias("_w"))
    # A first column of places, then both: the array of words is computed once for all uses.
    rows = rows.select("doc_id", "_key", F.size("_w").cast("long").alias("n_words"), F.concat(*[_hits(k, known[k]) for k in sorted(known)]).alias("_hits"))
    rows = staged(rows, "licenses")
    # Copies of a text bring the same hits; they are one before anything is counted.
    hits = rows.select("_key", F.explode("_hits").alias("_hit")).select("_key", "_hit.*").distinct()
    met = hits.join(F.broadcast(_template_table(spark)), (hits["k"] == F.col("_k")) & (hits["gram"] == F.col("_gram")))
    met = met.withColumn("_diagonal", F.col("pos") - F.col("_at"))
    # Which positions of the template a diagonal hits, as bits: repeats of one position count once.
    masks = [f"_mask{i}" for i in range(-(-max(at + 1 for _, _, at, _ in template_grams()) // MASK_BITS))]
    bit = lambda i: F.when(F.floor(F.col("_at") / MASK_BITS) == i, F.expr(f"shiftleft(1L, _at % {MASK_BITS})")).otherwise(F.lit(0).cast("long"))
    keys = ["_key", "_template", "_label", "_base", "_grams", "_width"]
    votes = met.groupBy(*keys, "_diagonal").agg(*[F.bit_or(bit(i)).alias(m) for i, m in enumerate(masks)])
    # One text's diagonals of one template stand together here, never several texts'.
    order = Window.partitionBy("_key", "_template").orderBy("_diagonal")
    whole = F.col("_width") == PHRASE_WORDS
    apart = F.coalesce(F.col("_diagonal") - F.lag("_diagonal").over(order) > F.when(whole, 0).otherwise(scan.band), F.lit(True))
    chains = votes.withColumn("_apart", apart.cast("int")).withColumn("_chain", F.sum("_apart").over(order))
    first = F.min("_diagonal").over(Window.partitionBy("_key", "_template", "_chain"))
    # A chain of neighbours may run on through a long text; a band of it spans no more words than the template.
    bands = chains.withColumn("_band", F.floor((F.col("_diagonal") - first) / (F.col("_grams") + F.col("_width") - 1)))
    spans = bands.groupBy(*keys, "_chain", "_band").agg(*[F.bit_or(m).alias(m) for m in masks], F.min("_diagonal").alias("_start"))
    hit = sum(F.bit_count(m) for m in masks)
    spans = spans.withColumn("_part", F.when(whole & (hit < F.col("_grams")), 0.0).otherwise(hit / F.col("_grams")))
    intact = F.col("_base") & (F.col("_part") == 1.0)
    found = spans.groupBy("_key").agg(
        F.count(F.when(intact, 1)).alias("n_base"),
        F.min(F.when(intact, F.col("_start"))).cast("long").alias("first_word"),
        F.max(F.when(intact, F.col("_start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(intact, F.col("_label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("_part") >= scan.coverage, F.col("_label")))), ",").alias("labels"),
        F.max("_part").alias("score"),
    )
    return join_hot(rows.drop("_hits"), found, "_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def license_sql(scan: Scan = Scan()) -> str:
    """The same scan for the check, over strings instead of hashes."""
    grams = ", ".join(f"({t}, {k}, {at}, '{g}')" for t, k, at, g in template_grams())
    facts = ", ".join(f"({i}, '{label}', {str(base).upper()}, {len(text.split(' ')) - k + 1}, {k})" for i, label, text, k, base in templates())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH grams(t, k, slot, gram) AS (VALUES {grams}), facts(t, label, base, grams, width) AS (VALUES {facts}),
rows AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM rows, (SELECT unnest([{PHRASE_WORDS}, {NOTICE_WORDS}]) AS k)),
met AS (SELECT rid, g.t, slot, i - 1 - slot AS d FROM (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM places) p JOIN grams g ON p.k = g.k AND p.gram = g.gram),
votes AS (SELECT DISTINCT rid, t, d FROM met),
apart AS (SELECT v.*, f.* EXCLUDE (t), CASE WHEN d - lag(d) OVER (PARTITION BY rid, v.t ORDER BY d) <= CASE WHEN width = {PHRASE_WORDS} THEN 0 ELSE {scan.band} END THEN 0 ELSE 1 END AS a
    FROM votes v JOIN facts f ON v.t = f.t),
chains AS (SELECT *, sum(a) OVER (PARTITION BY rid, t ORDER BY d) AS chain FROM apart),
bands AS (SELECT *, (d - min(d) OVER (PARTITION BY rid, t, chain)) // (grams + width - 1) AS band FROM chains),
spans AS (SELECT rid, label, base, min(d) AS start, CASE WHEN width = {PHRASE_WORDS} AND count(DISTINCT slot) < grams THEN 0.0 ELSE CAST(count(DISTINCT slot) AS DOUBLE) / grams END AS part
    FROM bands JOIN met USING (rid, t, d) GROUP BY rid, t, label, base, grams, width, chain, band),
found AS (SELECT rid, count(*) FILTER (base AND part = 1) AS n_base, min(start) FILTER (base AND part = 1) AS first_word, max(start) FILTER (base AND part = 1) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (base AND part = 1)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label) FILTER (part >= {scan.coverage})), ',') AS labels, max(part) AS score FROM spans GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM rows LEFT JOIN found USING (rid)
"""
