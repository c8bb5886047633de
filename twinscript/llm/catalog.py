"""The registered queries of this subpackage: name -> (Spark query, SQL for the check or None)."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.llm import divergence, extraction, licenses, mixing, packing, quality, simhash, sketches, spelling, substrings, suffixes, topk, toxicity
from twinscript.llm.tables import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(read(spark, sf_dir, "documents"), window=35).drop("removed")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


OP4_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
terms AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM rows),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM terms q JOIN terms c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, widest=3)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.quality_rules(read(spark, sf_dir, "documents")).select(*columns)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_array_dedup(read(spark, sf_dir, "documents"), window=400).withColumn("removed", F.col("n_removed") > 0)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main_text(read(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read(spark, sf_dir, "documents"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints_beside_next(read(spark, sf_dir, "documents"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_best_fit_packing": (op1_best_fit_packing, None),
    "op2_substring_dedup": (op2_substring_dedup, substrings.substring_sql(35)),
    "op3_license_scans": (op3_license_scans, licenses.license_sql()),
    "op4_exact_top_k": (op4_exact_top_k, OP4_SQL),
    "op5_toxicity": (op5_toxicity, None),
    "op8_simhash_near_dedup": (op8_simhash_near_dedup, None),
    "op6_quality_rules": (op6_quality_rules, quality.quality_sql()),
    "op7_suffix_array_dedup": (op7_suffix_array_dedup, None),
    "op9_source_mixing": (op9_source_mixing, None),
    "op10_html_extraction": (op10_html_extraction, None),
    "op11_spelling_variants": (op11_spelling_variants, spelling.spelling_sql()),
    "op12_source_divergence": (op12_source_divergence, divergence.divergence_sql()),
    "op13_document_fingerprints": (op13_document_fingerprints, None),
}
