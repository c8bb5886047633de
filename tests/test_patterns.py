"""Short cuts before patterns leave every result what the plain pattern gives."""

import random

from pyspark.sql import functions as F

from twinscript.functions import casing, text

SPACES = "\t\n\x0b\x0c\r\x1c\x85\xa0 ᠎   ​    　﻿"
PHRASES = ["with", "k-a", "and", "and so", "ſet"]


def drawn(n=3000):
    rng = random.Random(7)
    pieces = list(SPACES) + [" ", " ", "  ", "a", "word", "With", "AND", "and so", "K-a", "K-a", "set", "ſET", "「x」", "、", "。", "–", " - ", "1-2", '"', ".", "〜", "：", "é", "[b]"]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(n)] + ["", None, " ", "　"]


def plain_marks(column, table):
    for mark, wanted in table.items():
        column = F.replace(column, F.lit(mark), F.lit(wanted))
    return column


def test_short_cuts_equal_the_plain_patterns(values):
    old_phrase = "(?iU)" + "|".join(rf"\b{p}\b" for p in PHRASES)
    pairs = {
        "strip": (lambda c: text.strip_text(c), lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")),
        "collapse": (lambda c: text.collapse_whitespace(c), lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))),
        "marks": (lambda c: text.replace_marks(c, text.rules.PUNCTUATION), lambda c: plain_marks(c, text.rules.PUNCTUATION)),
        "phrases": (lambda c: F.regexp_extract_all(c, F.lit(casing.any_phrase(PHRASES)), F.lit(0)), lambda c: F.regexp_extract_all(c, F.lit(old_phrase), F.lit(0))),
        "few words": (lambda c: text.has_at_most(c, 3), lambda c: F.regexp_count(c, F.lit(r"(?U)\S+")) <= 3),
    }
    rows = drawn()
    got = values(rows, "s string", lambda c: F.struct(*[F.struct(new(c("s")).alias("a"), old(c("s")).alias("b")).alias(k) for k, (new, old) in pairs.items()]))
    for row, source in zip(got, rows):
        for name in pairs:
            assert row[name]["a"] == row[name]["b"], (name, source)


def test_long_texts_are_not_counted_for_their_kind(spark):
    plan = spark.range(1).select(text.classify_segment_kind(F.col("id").cast("string")), text.classify_kind_by_length(F.col("id").cast("string")))
    assert "regexp_count" not in plan._jdf.queryExecution().toString().lower()


def test_a_round_trip_translates_once(spark):
    from twinscript.operators.lengths import mask_round_trip_check

    rows = spark.createDataFrame([("call 12 at a.b@ex.org",), ("no marks",), ("7 of 9",), (None,)], "text string")
    checked = mask_round_trip_check(rows, lambda masked: F.replace(masked, F.lit("⟦NUM_2⟧"), F.lit("LOST")))
    assert checked._jdf.queryExecution().analyzed().toString().count("LOST") == 1
    assert [(r.text, r.translated, r.same_text, r.same_placeholders) for r in checked.collect()] == [("7 of 9", "⟦NUM_1⟧ of LOST", True, False)]


def test_links_are_counted_where_they_may_stand(spark, values):
    from twinscript.functions.length import counts_preserved

    pairs = [("a https://x.y b", "a b"), ("www.a.b", "http://c"), ("http:/ ://", "plain"), (None, "x"), ("x", None), ("1 two", "two")]
    got = [spark.createDataFrame([p], "a string, b string").select(counts_preserved(F.col("a"), F.col("b"))).first()[0] for p in pairs]
    assert got == [False, True, True, None, None, False]
    plan = spark.createDataFrame([("x", "y")], "a string, b string").select(counts_preserved(F.col("a"), F.col("b")))
    assert "contains" in plan._jdf.queryExecution().analyzed().toString().lower()
