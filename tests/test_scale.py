"""Hot groups: results stay whole, plans stay spread out."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from twinscript.operators import decks, islands, matching, memory, ordering
from twinscript.operators.segments import sample_first_blocks
from twinscript.session import shuffle_partitions, small_table


@pytest.fixture(scope="module")
def hot_deck(spark):
    """One deck holds most rows; the others a few each."""
    return (
        spark.range(20000)
        .select(
            F.when(F.col("id") < 15000, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 50)).alias("deck_id"),
            F.concat(F.lit("ppt/slides/slide"), F.col("id") % 97, F.lit(".xml")).alias("part_name"),
            F.col("id").alias("para_idx"),
            F.when(F.col("id") % 7 < 4, F.concat(F.lit("• going "), F.col("id"))).otherwise("A sentence with a stop.").alias("text"),
        )
        .repartition(8)
    )


@pytest.fixture
def many_ranges(spark):
    """Keep ranges apart that adaptive execution would merge at this size."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    saved = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, saved)


def test_number_rows_equals_a_window(spark, hot_deck, many_ranges):
    order = ["part_name", "para_idx"]
    plain = hot_deck.withColumn("want", F.row_number().over(Window.partitionBy("deck_id").orderBy(*order)))
    got = ordering.number_rows(hot_deck, ["deck_id"], order, "rn").join(plain, ["deck_id", *order])
    assert got.filter("rn = want").count() == 20000


def test_a_null_group_is_kept(spark, hot_deck, many_ranges):
    rows = hot_deck.withColumn("deck_id", F.when(F.col("deck_id") != "hot", F.col("deck_id")))
    order = ["part_name", "para_idx"]
    numbered = ordering.number_rows(rows, ["deck_id"], order, "rn")
    assert numbered.filter("deck_id is null").agg(F.count("*"), F.max("rn"), F.countDistinct("rn")).first() == (15000,) * 3
    ran = ordering.running_totals(rows, ["deck_id"], order, {"n": F.lit(1)})
    assert ran.filter("deck_id is null").agg(F.max("n")).first()[0] == 15000 and ran.count() == 20000


def test_running_totals_equal_a_window(spark, hot_deck, many_ranges):
    order = ["part_name", "para_idx"]
    window = Window.partitionBy("deck_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    plain = hot_deck.withColumn("want", F.sum(F.col("para_idx") % 5).over(window))
    ran = ordering.running_totals(hot_deck, ["deck_id"], order, {"total": F.col("para_idx") % 5})
    assert ran.join(plain, ["deck_id", *order]).filter("total = want").count() == 20000


def test_a_hot_deck_is_cut_into_ranges(spark, hot_deck, many_ranges):
    ranged = hot_deck.repartitionByRange("deck_id", "part_name", "para_idx").withColumn("_chunk", F.spark_partition_id())
    per_chunk = ranged.groupBy("deck_id", "_chunk").agg(F.count("*").alias("rows")).cache()
    assert per_chunk.agg(F.max("rows")).first()[0] < 20000 / 3
    # What is broadcast stays below the number of ranges.
    assert 1 < ordering._offsets(per_chunk, ["deck_id"], ["rows"]).count() < 8


def test_islands_equal_a_plain_scan(spark, hot_deck, many_ranges):
    from itertools import groupby

    want = set()
    rows = sorted((r.deck_id, r.part_name, r.para_idx, r.text) for r in hot_deck.collect())
    for deck, items in groupby(rows, key=lambda r: r[0]):
        start, members = None, 0
        for pos, item in enumerate([*items, None]):
            bullet = item is not None and ("•" in item[3] or (len(item[3].split()) < 15 and not item[3].endswith(".")))
            if bullet:
                start, members = (pos, 1) if start is None else (start, members + 1)
            elif start is not None:
                if members >= 2:
                    want.add((deck, start, start + members - 1, members))
                start = None
    got = {(r.deck_id, r.first_index, r.last_index, r.n_items) for r in islands.bullet_groups(hot_deck).collect()}
    assert got == want


def test_hot_text_splits_the_lookup_join(spark):
    """A text that fills a partition is split by adaptive execution."""
    saved = {
        k: spark.conf.get(k)
        for k in (
            "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        )
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20KB")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "10KB")
    try:
        text = F.when(F.col("id") % 3 == 0, "日本").otherwise(F.concat(F.lit("日"), F.col("id")))
        segments = spark.range(0, 60000, 1, 8).select(
            F.lit("d").alias("deck_id"), F.sha2(F.col("id").cast("string"), 256).alias("part_name"), F.col("id").alias("para_idx"),
            text.alias("text"),
        )
        tm = segments.select(F.col("text").alias("src")).distinct().withColumn("tgt", F.concat(F.lit("t"), "src"))
        out = memory.lookup_translations(segments, tm)
        assert out.agg(F.count("*"), F.count_if(F.col("tgt") == F.concat(F.lit("t"), "src"))).first() == (60000, 60000)
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in saved.items():
            spark.conf.set(key, value)


def test_first_blocks_are_limited_before_the_shuffle(spark):
    blocks = spark.range(1000).select(
        F.concat(F.lit("d"), F.col("id") % 3).alias("deck_id"), F.lit("slide").alias("part_kind"), F.lit("p").alias("part_name"),
        F.col("id").alias("block_idx"), F.lit("日").alias("text"),
    )
    plan = sample_first_blocks(blocks, "日", 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_deck_audit_pages(spark):
    rows = spark.range(2500).select(
        F.lit("d").alias("deck_id"), F.concat(F.lit("ppt/slides/slide"), "id", F.lit(".xml")).alias("slide"),
        F.lit(0).cast("long").alias("idx"), F.lit("日").alias("src"), F.lit("day").alias("tgt"),
    )
    records = decks.deck_audit(rows).collect()
    assert sorted(len(r.per_slide_before) for r in records) == [500, 1000, 1000]
    assert {(r.unique_strings, r.api_calls, r.jp_chars_before, r.jp_chars_after) for r in records} == {(1, 1, 2500, 0)}


def test_large_rule_tables_give_the_same_pairs(spark):
    words = ["alpha", "Beta", "g", "delta-x", "日本", "été", "a.b", "$5", "beta gamma", "ße",
             "internationalization", "internationalisation", "international", "--", "ΣΟΦΟΣ", "kiſs"]
    texts = ["Alpha beta gamma", "delta-x $5 a.b", "日本のalpha", "Été ÉTÉ g", "nothing", "alphabet xße ße", "",
             "an internationalization of a--b", "INTERNATIONAL internationalisation", "σοφος σοφοσ KISS"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    table = small_table(spark, [(w,) for w in words], "term string")
    for options in ({}, {"ignore_case": True}, {"word": True}):
        pairs = [
            sorted(
                (r.i, r.term)
                for r in matching.match_rules(rows, F.col("text"), table, "term", inline=inline, **options).collect()
            )
            for inline in (256, 0)
        ]
        assert pairs[0] == pairs[1] and pairs[0]


def test_rule_table_beyond_the_bound_is_never_collected(spark):
    table = spark.range(1000).select(F.concat(F.lit("term"), "id").alias("term"))
    assert matching.bounded_rows(table) is None
    rows = spark.createDataFrame([(0, "has term77 inside")], "i int, text string")
    got = sorted(r.term for r in matching.match_rules(rows, F.col("text"), table, "term").collect())
    assert got == ["term7", "term77"]


def test_terms_that_begin_alike_are_kept_apart(spark):
    """A shared beginning does not pair every text with every term."""
    table = spark.range(500).select(F.format_string("internal system %03d", "id").alias("term"))
    rows = spark.range(200).select(F.format_string("the internal system %03d here", "id").alias("text"))
    for pairs in (matching._pairs_by_gram, matching._pairs_by_word):
        assert pairs(rows, F.col("text"), table, F.col("term")).count() == 200
    assert matching.match_rules(rows, F.col("text"), table, "term").count() == 200


def test_shuffle_sizing():
    assert shuffle_partitions(10 * 2**20, 8) == 16
    assert shuffle_partitions(2**40, 400) == 4096
    assert shuffle_partitions(100 * 2**40, 4000) == 409_600
