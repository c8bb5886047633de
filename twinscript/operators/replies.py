"""Model replies as data: the array of strings inside a reply."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FENCE = r"(?m)^```(?:json)?|```$"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _embedded_array(replies: pd.Series, expected: pd.Series) -> pd.Series:
    """First JSON array outside a string with enough items; rows already served are null."""
    decoder = json.JSONDecoder()

    def scan(text: str, n: int) -> list | None:
        quoted, i = False, 0
        while i < len(text):
            ch = text[i]
            if quoted and ch == "\\":
                i += 2
                continue
            if ch == '"':
                quoted = not quoted
            elif ch == "[" and not quoted:
                try:
                    found, end = decoder.raw_decode(text, i)
                except (ValueError, RecursionError):  # no array, or one nested deeper than any list of texts
                    i += 1
                    continue
                if len(found) >= n:
                    return [str(x) for x in (found[:n] if n else found)]
                i = end
                continue
            i += 1
        return None

    return pd.Series([None if t is None else scan(t, int(n)) for t, n in zip(replies, expected)], dtype="object")


def parse_model_array(df: DataFrame, reply: str = "reply", expected: str = "expected_len") -> DataFrame:
    """Add ``items``: the reply's array of strings cut to its expected length, or null.

    A reply that is nothing but an array (in a code fence or not) is read in the
    JVM. Only the others go through the scan for an embedded array.
    """
    n = F.col(expected)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col(reply), r"(?U)\A\s+|\s+\z", ""), FENCE, ""))
    bare = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    only_strings = F.schema_of_variant(F.try_parse_json(bare)) == "ARRAY<STRING>"
    clean: Column = F.when(bare.startswith("[") & only_strings, F.from_json(bare, "array<string>"))
    parsed = df.withColumn("_text", text).withColumn("_clean", clean)
    enough = F.coalesce((F.size("_clean") >= n) & ~F.exists("_clean", lambda x: x.isNull()), F.lit(False))
    scanned = _embedded_array(F.when(~enough, F.col("_text")), n)
    cut = F.when(n == 0, F.col("_clean")).otherwise(F.slice("_clean", F.lit(1), n))
    return parsed.withColumn("items", F.when(enough, cut).otherwise(scanned)).drop("_text", "_clean")
