"""What the operators share: reading a table, stages in the shared folder, content keys."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.session import drop_stage, scratch_path, staged

__all__ = ["read", "drop_stage", "scratch_path", "staged", "staged_texts", "text_of", "content_key"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged_texts(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read again like ``staged``, packed tighter, for tables that hold whole texts."""
    return staged(df, label, compression="zstd")


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def content_key(column: str = "text") -> Column:
    """128 bits that stand for a text, so that all copies of a text share one result."""
    return F.unhex(F.md5(F.encode(text_of(column), "UTF-8")))
