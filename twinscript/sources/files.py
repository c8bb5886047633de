"""Text, CSV, JSON and parquet files in, result files out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript import rules, schemas
from twinscript.functions.text import classify_kind_by_length
from twinscript.session import small_table

CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}
# Texts are written whole: the writer would trim them by default. A reader cannot split a file whose
# texts break lines, so no file outgrows a task.
CSV_OUT = {
    "maxRecordsPerFile": "20000",
    "header": "true", "quote": '"', "escape": '"', "quoteAll": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def parse_kv_json(df: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """Entries of JSON objects held in a column, next to the other columns."""
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.explode(F.map_entries(F.from_json(column, "map<string,string>"))).alias("_e")).select(
        *keep, F.col("_e.key").alias(key), F.col("_e.value").alias(value)
    )


def read_kv_json(spark: SparkSession, path: str, key: str = "key", value: str = "value", lines: bool = False) -> DataFrame:
    """Entries of one JSON object per file (cache, glossary, patch), or with ``lines`` of one object per line.

    A whole file is one record; files of lines split. Keep a large memory with
    :func:`write_tm`, and use this to import it.
    """
    return parse_kv_json(spark.read.text(path, wholetext=not lines), "value", key, value)


def parse_pricing(df: DataFrame, column: str) -> DataFrame:
    """Price rows from JSON objects ``{model: rates}``.

    The tokenizer falls back to its default, missing rates are null, and entries
    without the ``provider:`` prefix (such as file metadata) are no models.
    """
    entry = F.from_json(column, f"map<string,{schemas.PRICING_ENTRY}>")
    return (
        df.select(F.explode(F.map_entries(entry)).alias("_e"))
        .filter(F.col("_e.key").contains(":"))
        .select(
            F.col("_e.key").alias("model"),
            F.substring_index("_e.key", ":", 1).alias("provider"),
            *[F.col(f"_e.value.{c}").alias(c) for c in ("in", "in_cached", "out", "cached_write", "cached_read")],
            F.coalesce("_e.value.tokenizer", F.lit(rules.DEFAULT_TOKENIZER)).alias("tokenizer"),
        )
    )


def read_pricing(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Price rows of one JSON object per file, or with ``lines`` per line."""
    return parse_pricing(spark.read.text(path, wholetext=not lines), "value")


def read_bilingual_csv(spark: SparkSession, path: str, deck_id: str | None = None) -> DataFrame:
    """Bilingual rows with their kind; rows short of four fields are dropped.

    The deck is ``deck_id`` if given, else the file's fifth column of that name, else the
    file. All files of a path have the same columns.
    """
    named = "deck_id" in spark.read.options(**CSV).csv(path).columns
    fields = schemas.BILINGUAL_FILE + (", deck_id string" if named else "")
    # An empty field and a missing one both read as null; only a short row is malformed.
    raw = (
        spark.read.options(**CSV, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
        .schema(fields + ", _corrupt_record string")
        .csv(path)
    )
    deck = F.lit(deck_id) if deck_id is not None else F.col("deck_id") if named else F.input_file_name()
    complete = F.col("tgt").isNotNull() | F.col("_corrupt_record").isNull()
    text = F.coalesce("tgt", F.lit(""))
    return raw.filter(complete).select(
        deck.alias("deck_id"),
        "slide",
        F.col("idx").cast("long").alias("idx"),
        F.coalesce("src", F.lit("")).alias("src"),
        text.alias("tgt"),
        classify_kind_by_length(text).alias("kind"),
    )


def write_bilingual(df: DataFrame, path: str) -> None:
    """Bilingual rows under the file's own four column names, and their deck behind them.

    Readers that go by position find the four where they expect them.
    """
    df.select(
        F.col("slide").alias("slide_xml"),
        F.col("idx").alias("paragraph_idx"),
        F.col("src").alias("Japanese"),
        F.col("tgt").alias("English"),
        "deck_id",
    ).write.options(**CSV_OUT).csv(path)


def write_tm(df: DataFrame, path: str, version: str) -> None:
    """Write one version of the memory; earlier versions stay as they are.

    A line of the manifest names the version once it is whole, so readers never see a part of one.
    """
    df.select("src", "tgt").write.mode("errorifexists").parquet(f"{path}/version={version}")
    small_table(df.sparkSession, [(version,)], "version string").coalesce(1).write.mode("append").json(f"{path}/_manifest")


def tm_versions(spark: SparkSession, path: str) -> list[str]:
    """The memory's whole versions, ascending by name. Only the manifest is read."""
    lines = spark.read.schema("version string").json(f"{path}/_manifest")
    return sorted(r["version"] for r in lines.distinct().collect())


def read_tm(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """A version of the memory, the last one (by name) when none is given.

    Only that version's files are listed and read.
    """
    version = tm_versions(spark, path)[-1] if version is None else version
    return spark.read.schema(schemas.MEMORY).parquet(f"{path}/version={version}")


def write_audit(audits: DataFrame, path: str, records_per_file: int = 0) -> None:
    """Audit records as JSON, one file set per run, of any number of records a file unless it is bounded."""
    audits.write.option("maxRecordsPerFile", records_per_file).json(path)


def read_run_audits(spark: SparkSession, glob: str, run_rx: str = r"run-([^/]+?)(?:-artifacts)?/") -> DataFrame:
    """Audit records of many runs, the run id from the path. A file holds one record or an array of records, over any lines."""
    fields = schemas.RUN_AUDIT
    multi = spark.read.schema(fields).json(glob, multiLine=True)
    return multi.select(F.regexp_extract(F.input_file_name(), run_rx, 1).alias("run_id"), "*")


def read_run_audit_lines(spark: SparkSession, glob: str, run_rx: str = r"run=([^/]+)/") -> DataFrame:
    """Records written by :func:`write_audit`."""
    lines = spark.read.schema(schemas.RUN_AUDIT).json(glob)
    return lines.select(F.regexp_extract(F.input_file_name(), run_rx, 1).alias("run_id"), "*")


def slides_of_audits(audits: DataFrame) -> DataFrame:
    """The two per-slide maps of audit records as rows."""
    return audits.select(
        "run_id", "deck_id", F.explode("per_slide_before").alias("part_name", "n_before"), "per_slide_after"
    ).select("run_id", "deck_id", "part_name", "n_before", F.col("per_slide_after")[F.col("part_name")].alias("n_after"))


def write_issue_report(issues: DataFrame, path: str) -> None:
    """The six report columns as CSV, and the deck behind them."""
    issues.select(
        "category", "slide", F.col("idx").alias("index"), "issue_type", "description", "suggested_fix", "deck_id"
    ).write.options(**CSV_OUT).csv(path)


def write_worklist(worklist: DataFrame, path: str) -> None:
    """Texts to translate as CSV, with an empty column to fill in and an example of where each stands."""
    worklist.select("jp_text", "proposed_en", "slide_example", "deck_example").write.options(**CSV_OUT).csv(path)


def read_worklist(spark: SparkSession, path: str) -> DataFrame:
    """A worklist that people filled in: ``jp_text, proposed_en, slide_example``; an empty proposal is null."""
    return spark.read.options(**CSV, mode="PERMISSIVE").schema("jp_text string, proposed_en string, slide_example string").csv(path)
