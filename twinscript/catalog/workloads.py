"""The shared tables in the shapes the operators read.

The tables hold no source script and no tags, so both are put in by expression:
vowels of non-English documents become kana. The SQL in :mod:`sql` does the same.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.functions.script import has_script
from twinscript.functions.text import is_nonblank
from twinscript.operators.audits import with_kind
from twinscript.operators.segments import split_paragraphs
from twinscript.session import small_table, spread

LATIN, KANA = "aeiou,.", "あいうえお、。"

BANNED = {"with": "using", "which": "that", "and": "plus"}
GLOSSARY = [("lあ", "la"), ("うd", "and"), ("dえ", "the"), ("え", "en")]
ALTERNATIVES = {"うd": ["und", "with"], "dえ": ["der", "die", "les"]}
MARKS = {"、": ", ", "。": ". ", "お": "o"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deck parts: a source is a deck, a document is one of its slides."""
    docs = table(spark, sf_dir, "documents")
    return spread(docs.select("doc_id", "text", "lang", "source"), "doc_id").select(
        F.col("source").alias("deck_id"),
        F.lit("slide").alias("part_kind"),
        F.concat(F.lit("ppt/slides/slide"), F.col("doc_id"), F.lit(".xml")).alias("part_name"),
        F.col("doc_id").alias("part_no"),
        "doc_id",
        "lang",
        "text",
    )


def in_kana(text: Column) -> Column:
    return F.translate(text, LATIN, KANA)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deck parts, non-English ones with source script."""
    return documents(spark, sf_dir).withColumn(
        "text", F.when(F.col("lang") != "en", in_kana(F.col("text"))).otherwise(F.col("text"))
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_paragraphs(parts(spark, sf_dir))


def bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and target per paragraph; targets differ in kind of defect by language."""
    line = F.col("text")
    tgt = (
        F.when(
            F.col("lang") == "fr",
            F.concat(F.lit("[b]"), line, F.when(line.endswith("."), "[/b]").otherwise("")),
        )
        .when(F.col("lang") == "de", F.replace(line, F.lit("und"), F.lit("おと")))
        .when(F.col("lang") == "es", F.concat(F.lit("• "), line))
        .otherwise(line)
    )
    return with_kind(
        split_paragraphs(documents(spark, sf_dir)).select(
            "deck_id",
            F.col("part_name").alias("slide"),
            F.col("para_idx").alias("idx"),
            F.translate(line, LATIN + "nrst", KANA).alias("src"),
            tgt.alias("tgt"),
        )
    )


def target_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets as a paragraph table."""
    return bilingual(spark, sf_dir).select(
        "deck_id", F.col("slide").alias("part_name"), F.col("idx").alias("para_idx"), F.col("tgt").alias("text")
    )


def checked_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets in review batches: one slide is one batch."""
    return bilingual(spark, sf_dir).select(
        F.col("slide").alias("batch_id"), F.col("idx").alias("index"), F.col("tgt").alias("text")
    )


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory of the texts in labelled documents: good, half done, or unchanged by label."""
    labels = table(spark, sf_dir, "labels")
    back = F.translate("text", KANA, LATIN)
    return (
        segments(spark, sf_dir)
        .filter(has_script(F.col("text")))
        .join(labels, "doc_id")
        .groupBy("text")
        .agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
        .select(
            F.col("text").alias("src"),
            F.when(F.col("toxic") == 1, F.col("text"))
            .when(F.col("quality") == 0, F.concat(F.lit("TM "), F.col("text")))
            .otherwise(back)
            .alias("tgt"),
        )
    )


def memory_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories of several runs: a part's name is the source, its brand a rendering."""
    return table(spark, sf_dir, "part").select(
        F.col("p_name").alias("src"), F.col("p_size").alias("run_id"), F.col("p_brand").alias("tgt")
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id").select(
        F.col("page_id").cast("string").alias("deck_id"), F.lit("slide").alias("part_kind"), "url", "html"
    )


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as notes of the deck their conversation stands for."""
    return table(spark, sf_dir, "conversations").filter(is_nonblank(F.col("text"))).select(
        F.col("conv_id").cast("string").alias("deck_id"), F.col("turn").alias("block_idx"), "role", "text"
    )


def glossary(spark: SparkSession) -> DataFrame:
    return small_table(spark, GLOSSARY, "term string, expected string")


def slide_xml(text: Column) -> Column:
    """Lines of a text as paragraphs of slide markup, every second run in bold."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    paragraphs = F.transform(
        F.split(escaped, "\n", -1),
        lambda line, i: F.concat(
            F.lit("<a:p><a:r>"),
            F.when(i % 2 == 1, '<a:rPr b="1" sz="1800"><a:latin typeface="Arial"/></a:rPr>').otherwise('<a:rPr sz="2400"/>'),
            F.lit("<a:t>"),
            line,
            F.lit("</a:t></a:r></a:p>"),
        ),
    )
    return F.concat(
        F.lit(
            '<p:sld xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" '
            'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main">'
            '<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><a:txBody><a:bodyPr lIns="10"/>'
        ),
        F.array_join(paragraphs, ""),
        F.lit("</a:txBody></p:sp></p:sld>"),
    )


def slide_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as slide markup. Control characters are no XML and become spaces."""
    clean = F.regexp_replace("text", r"[\x00-\x09\x0b-\x1f]", " ")
    return documents(spark, sf_dir).select(
        "deck_id", "part_kind", "part_name", "part_no", slide_xml(clean).alias("xml")
    )
