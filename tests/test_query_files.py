"""Files that queries write on their way: their number and size stay in proportion, and every row comes back."""

import pytest
from pyspark.sql import functions as F

from twinscript.catalog import CATALOG


@pytest.fixture
def suppliers(spark, tmp_path):
    """A thousand suppliers of thirty names, in one file; few parts and turns."""
    ids = spark.range(0, 1000, 1, 1).select(
        F.col("id").alias("s_suppkey"),
        F.concat(F.lit('name "'), F.col("id") % 30, F.lit('", {}\n')).alias("s_name"),
        (F.col("id") % 25).cast("int").alias("s_nationkey"),
        F.when(F.col("id") % 7 > 0, F.col("id") / 8).alias("s_acctbal"),
    )
    ids.write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("SELECT 1L p_partkey, 2.5D p_retailprice, 30 p_size, 'x' p_type").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("SELECT 1L conv_id, 0 turn, 'user' role, 'hello' text").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_price_files_hold_many_entries(spark, suppliers):
    read = CATALOG["read_pricing"][0](spark, suppliers)
    assert len(read.inputFiles()) < 10
    got = {r["model"]: r["in"] for r in read.filter("provider = 'supplier'").collect()}
    assert got == {f"supplier:{i}": i / 8 if i % 7 else None for i in range(1000)}


def test_object_files_hold_many_entries_and_equal_keys(spark, suppliers):
    read = CATALOG["read_kv_json"][0](spark, suppliers)
    assert len(read.inputFiles()) < 10
    got = sorted((r["key"], r["value"]) for r in read.filter("file = 'supplier'").collect())
    names = [f'name "{i % 30}", {{}}\n' for i in range(1000)]
    assert got == sorted([(n, str(i % 25)) for i, n in enumerate(names)] + [(f"key of {n}", str(i)) for i, n in enumerate(names)])


def test_audit_files_hold_many_records(spark, tmp_path):
    # Every document is a page of its own, so a record of its own.
    spark.range(0, 600, 1, 1).selectExpr("id * 1000 doc_id", "concat('a ', id, ' \"b\", [e]') text", "'de' lang", "'s' source").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    read = CATALOG["read_run_audits"][0](spark, str(tmp_path))
    assert len(read.inputFiles()) <= 2 * 8
    got = read.select("run_id", "deck_id", "part_name").collect()
    assert sorted(map(tuple, got)) == sorted(("base", "s", f"ppt/slides/slide{i * 1000}.xml") for i in range(600))


def test_decks_lie_in_bundles(spark, tmp_path):
    docs = spark.range(0, 3000, 1, 8).selectExpr("id doc_id", "concat('text ', id) text", "'en' lang", "'s' source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    read = CATALOG["read_decks"][0](spark, str(tmp_path))
    assert len(read.inputFiles()) <= 2 * 8
    got = read.groupBy("unreadable").agg(F.count("*"), F.countDistinct("deck")).collect()
    assert sorted(map(tuple, got)) == [(False, 5400, 2700), (True, 300, 300)]


@pytest.mark.parametrize("name", ["write_bilingual", "read_bilingual_csv"])
def test_no_csv_file_holds_all_rows(spark, tmp_path, name):
    spark.range(0, 50_000, 1, 1).selectExpr("id doc_id", "concat('a, \"b\" ', id) text", "'de' lang", "'s' source").coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.sql("SELECT 0L doc_id, 's' source, 'de' lang, 'x' text").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    read = CATALOG[name][0](spark, str(tmp_path))
    per_file = read.groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first()
    assert per_file[0] <= 20_000 and per_file[1] == 50_001
