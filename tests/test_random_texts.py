"""Properties that hold for any text, on many made-up ones at once."""

import random

import pytest
from pyspark.sql import functions as F

from twinscript.functions import casing, length, masking, script, text

PIECES = [
    "a", "the", "Leverage", "leverage", "ROBUST", "x1", "日本", "、", "。", " ", "  ", "　", "\n", "\t", "3,5%", "12", "-", "–", "AB12-X",
    "https://e.x/1?a=2", "me@ex.org", "[b]", "[/b]", "[", "]", "•", ".", ";", ":", "!", '"', "(", ")", "ß", "é", "・", "１２", ", and ", "$1", "\\",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    rows = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 25))) for _ in range(1500)]
    return spark.createDataFrame(list(enumerate(rows)), "i int, s string")


def fails(df, condition):
    """Rows for which the condition is not true, null included."""
    return df.filter(~F.coalesce(condition, F.lit(False))).count()


def test_masking_round_trip(texts):
    s = F.col("s")
    df = texts.withColumn("m", masking.mask_fragile(s))
    assert fails(df, masking.unmask_fragile(F.col("m.masked"), F.col("m.marks")) == s) == 0
    assert fails(df, masking.placeholders(F.col("m.masked")) == F.array_sort(F.map_keys("m.marks"))) == 0
    assert fails(df, ~F.col("m.masked").contains("https://")) == 0


def test_title_case_changes_capitals_only(texts):
    s = F.col("s")
    plain = F.when(text.word_count(s) == 0, s).otherwise(text.collapse_whitespace(s))
    fold = lambda c: F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    assert fails(texts, fold(casing.title_case(s)) == fold(plain)) == 0
    once = casing.title_case(s)
    assert fails(texts, casing.title_case(once) == once) == 0


def test_collapsing_is_idempotent(texts):
    once = texts.withColumn("s", text.collapse_whitespace(F.col("s")))
    assert fails(once, text.collapse_whitespace(F.col("s")) == F.col("s")) == 0


def test_bullet_fragment_drops_one_mark_at_most(texts):
    trimmed = text.strip_text(F.col("s"))
    lost = F.length(trimmed) - F.length(text.bullet_fragment(F.col("s")))
    assert fails(texts, lost.between(0, 1)) == 0


def test_counts_agree_with_extraction(texts):
    s = F.col("s")
    assert fails(texts, script.count_script_chars(s, "日本") == F.length(script.extract_script_chars(s, "日本"))) == 0
    assert fails(texts, (script.count_script_chars(s) > 0) == script.has_script(s)) == 0


def test_spilled_text_is_kept(texts):
    """Stub and notes together hold every word, whatever the kind."""
    for kind in ("title", "bullet", "table", "body"):
        df = texts.withColumn("n", length.spill_to_notes(F.col("s"), F.lit(kind)))
        words = F.array_distinct(text.words(F.regexp_replace("s", r"[,;]|\b(?:and|but|or)\b", " ")))
        whole = F.concat("n.stub", F.lit(" "), "n.notes")
        assert fails(df, F.forall(words, lambda w: whole.contains(w))) == 0


def test_replace_banned_leaves_no_phrase(texts):
    done = casing.replace_banned(F.col("s"))
    assert fails(texts, ~done.rlike(casing.any_phrase(["leverage", "robust"]))) == 0
    untouched = texts.filter(~F.lower("s").rlike("leverage|robust"))
    assert fails(untouched, done == F.col("s")) == 0
