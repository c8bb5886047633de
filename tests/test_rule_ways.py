"""One answer whatever the size of a rule table: inline, broadcast and merged ways give the same rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from twinscript.operators import lengths, matching
from twinscript.session import small_table

WAYS = {"inline": {"inline": 256}, "broadcast": {"inline": 0}, "merge": {"inline": 0, "broadcast": 0}}
KEYS = ["deck_id", "slide", "idx"]
WORDS = ["cutting", "cutting edge", "edge", "Edge", "EDGE case", "a.b", "x", "x y", "y x", "$5", "naïve", "日本", "本", "Σοφός", "$", "", "edge edge"]


def drawn(seed):
    """Rule tables with ties, repeats, nulls and empty values; rows with repeated and null keys."""
    r = random.Random(seed)
    pick = lambda *more: r.choice([*WORDS, *more])
    banned = [(pick(None), r.choice(["s1", "s2", None]), r.choice([0, 1, 1, None])) for _ in range(14)]
    glossary = list({t: (t, pick(None)) for t in (pick(None) for _ in range(9))}.values())
    alternatives = [(r.choice(glossary)[0], pick(None), r.choice([0, 0, 1, None])) for _ in range(14)]
    text = lambda: r.choice([None, "", " ".join(pick() for _ in range(r.randint(1, 9))), "[b]" + pick() + "[/b] " + pick()])
    rows = [(r.choice(["d", None]), r.choice(["s", None]), r.choice([1, 2, None]), text(), text(), text()) for _ in range(40)]
    return banned, glossary, alternatives, rows + rows[:6]


@pytest.fixture(scope="module", params=range(3))
def tables(request, spark):
    banned, glossary, alternatives, rows = drawn(request.param)
    return (
        small_table(spark, banned, "phrase string, suggested string, place int"),
        small_table(spark, glossary, "term string, expected string"),
        small_table(spark, alternatives, "term string, alt string, place int"),
        spark.createDataFrame(rows, "deck_id string, slide string, idx long, src string, tgt string, notes string").repartition(3),
    )


OPERATORS = {
    "glossary_hits": lambda b, g, a, d, **kw: matching.glossary_hits(d, g, **kw),
    "glossary_missing": lambda b, g, a, d, **kw: matching.glossary_missing(d, g, **kw),
    "glossary_alternatives": lambda b, g, a, d, **kw: matching.glossary_alternatives(d, g, a, KEYS, **kw),
    "term_usage": lambda b, g, a, d, **kw: matching.term_usage(d, g, **kw),
    "term_variant_uses": lambda b, g, a, d, **kw: matching.term_variant_uses(d, g, a, **kw),
    "banned_phrase_flags": lambda b, g, a, d, **kw: matching.banned_phrase_flags(d, b, "tgt", **kw),
    "banned_word_matches": lambda b, g, a, d, **kw: matching.banned_word_matches(d, b, **kw),
    "punct_flags": lambda b, g, a, d, **kw: matching.punct_flags(d, b.withColumnsRenamed({"phrase": "original"}), "tgt", **kw),
    "content_integrity": lambda b, g, a, d, **kw: lengths.content_integrity(d, g, KEYS, "tgt", "notes", **kw),
}


@pytest.mark.parametrize("operator", OPERATORS)
def test_every_way_gives_the_same_rows(tables, operator):
    rows = {}
    for way, bounds in WAYS.items():
        out = OPERATORS[operator](*tables, **bounds)
        rows[way] = sorted((tuple(x) for x in out.select(sorted(out.columns)).collect()), key=repr)
    assert rows["inline"] == rows["broadcast"] == rows["merge"]
    assert rows["inline"]


def first_of_each_place(text, phrases):
    """Leftmost match, first in order at its place, found position by position."""
    out, at = [], 0
    patterns = [re.compile(rf"\b{re.escape(p)}\b", re.I) for p in phrases]
    while at < len(text):
        hit = next((m for p in patterns if (m := p.match(text, at))), None)
        if hit:
            out.append(hit[0])
        at = hit.end() if hit else at + 1
    return out


@pytest.mark.parametrize("way", WAYS)
def test_matches_are_leftmost_and_first_in_order(spark, way):
    r = random.Random(4)
    phrases = [("cutting edge", 1), ("cutting", 1), ("edge case", 0), ("edge", 2), ("case by case", 2), ("by", 0)]
    texts = [" ".join(r.choices(["cutting", "edge", "case", "by", "other"], k=r.randint(1, 14))) for _ in range(80)]
    banned = small_table(spark, [(p, p.upper(), k) for p, k in phrases], "phrase string, suggested string, place int")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, tgt string")
    got = {}
    for x in matching.banned_word_matches(rows, banned, keys=["i"], **WAYS[way]).collect():
        assert x["suggested"] == x["word"].upper()
        got.setdefault(x["i"], []).append(x["word"])
    order = [p for p, _ in sorted(phrases, key=lambda x: (x[1], x[0]))]
    want = {i: w for i, t in enumerate(texts) if (w := first_of_each_place(t, order))}
    assert {i: sorted(w) for i, w in got.items()} == {i: sorted(w) for i, w in want.items()}


def test_reported_cases(spark):
    """Order by place and text, empty terms, repeated and null keys."""
    row = spark.createDataFrame([("d", "s", 1, "source", "alpha zeta cutting edge")], "deck_id string, slide string, idx long, src string, tgt string")
    glossary = small_table(spark, [("t", "expected")], "term string, expected string")
    alternatives = small_table(spark, [("t", "zeta"), ("t", "alpha")], "term string, alt string")
    banned = small_table(spark, [("cutting edge", "advanced"), ("cutting", "slicing")], "phrase string, suggested string")
    empty = small_table(spark, [("", "x")], "term string, expected string")
    for bounds in WAYS.values():
        assert [x["found"] for x in matching.glossary_alternatives(row, glossary, alternatives, KEYS, **bounds).collect()] == ["alpha"]
        assert [x["word"] for x in matching.banned_word_matches(row, banned, **bounds).collect()] == ["cutting"]
        assert matching.glossary_hits(row, empty, **bounds).count() == 1
        twice = row.unionByName(row.withColumn("tgt", F.lit("expected"))).withColumn("idx", F.lit(None).cast("long"))
        terms = small_table(spark, [("source", "expected")], "term string, expected string")
        kept = lengths.content_integrity(twice.withColumn("notes", F.lit("")), terms, KEYS, "tgt", "notes", **bounds)
        assert sorted((x["tgt"], x["intact"]) for x in kept.collect()) == [("alpha zeta cutting edge", False), ("expected", True)]


def test_merged_texts_do_not_travel_with_their_keys(spark):
    """Beyond the broadcast bound only hashes come out of the explode and into its shuffle."""
    rows = spark.range(200).select("id", F.concat(F.lit("text number "), "id").alias("text"))
    table = spark.range(50).select(F.concat(F.lit("number "), "id").alias("term"))
    for options, pairs in (({}, 340), ({"word": True}, 50), ({"ignore_case": True}, 340)):
        out = matching.match_rules(rows, F.col("text"), table, "term", inline=0, broadcast=0, **options)
        lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = [i for i, line in enumerate(lines) if "Generate explode" in line]
        assert len(at) == 1 and "Generate explode(_keys#" in lines[at[0]]
        below = lines[at[0] + 1]
        assert "Project [xxhash64(" in below and below.count(" AS ") == 2 and " AS _text_id#" in below and " AS _keys#" in below
        assert out.count() == pairs


def test_keys_are_cut_only_where_one_may_begin(spark):
    table = small_table(spark, [("zebra",), ("zest",), ("",)], "term string")
    rows = spark.createDataFrame([(0, "a zebra without zest"), (1, "nothing"), (2, "")], "i int, text string")
    keyed = matching._rarest_key(table, F.col("term"), F.array_distinct(F.regexp_extract_all("_t", matching._gram_pattern(matching._gram_size(F.col("_t"))), F.lit(1))))
    assert all(first == "." or "\\x{" in first for _, first in matching._cuts(keyed))
    assert sorted((x["i"], x["term"]) for x in matching.match_rules(rows, F.col("text"), table, "term", inline=0).collect()) == [
        (0, ""), (0, "zebra"), (0, "zest"), (1, ""), (2, "")
    ]


def test_words_are_cut_only_where_one_may_begin(spark):
    rows = spark.createDataFrame([("Zest or zebra, azure İZ Ζ z",), ("ſo ςo so",), ("",), (None,)], "t string")
    cut = lambda first: [r[0] for r in rows.select(matching._words(F.col("t"), first)).collect()]
    assert cut("[\\x{7a}]") == [["zest", "zebra", "z"], [], [], None]
    assert cut(".") == [["zest", "or", "zebra", "azure", "iz", "ζ", "z"], ["so", "σo", "so"], [], None]
    table = small_table(spark, [("zebra",), ("zest or",)], "term string")
    out = matching.match_rules(rows, F.col("t"), table, "term", word=True, inline=0)
    assert "\\x{" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["term"] for r in out.collect()) == ["zebra", "zest or"]


def test_alternatives_read_their_rows_once(spark, tmp_path):
    """Rows alike in all that is shown, texts included, each get their answer."""
    rows = [("d", None, 1, "[b]der[/b] die x"), ("d", None, 1, "[b]der[/b] die x"), ("d", None, 1, "der die x"), ("d", "s", 1, "the der"), ("e", "s", 1, None)]
    spark.createDataFrame(rows, "deck_id string, slide string, idx long, tgt string").write.parquet(f"{tmp_path}/rows")
    glossary = small_table(spark, [("T", "the")], "term string, expected string")
    alternatives = small_table(spark, [("T", "die", 1), ("T", "der", 0), ("T", "der", 0), ("T", "x", 2)], "term string, alt string, place int")
    read = spark.read.parquet(f"{tmp_path}/rows")
    out = matching.glossary_alternatives(read, glossary, alternatives, KEYS, inline=0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [deck_id" in line for line in plan.splitlines()) == 1
    assert [tuple(r) for r in out.orderBy("context").collect()] == [
        ("d", None, 1, "T", "the", "der", c) for c in ("[b]der[/b] die x...", "[b]der[/b] die x...", "der die x...")
    ]
