"""Name -> (Spark query, SQL for the check)."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in CATALOG:
            raise ValueError(f"{name} is registered twice")
        CATALOG[name] = (fn, sql)
        return fn

    return register
