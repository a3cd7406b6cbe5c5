"""Queries by operator name, each with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.workload.oracle_base import oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, replaced: dict[str, str] | None = None) -> Callable[[Query], Query]:
    """Register a query under an operator's name; ``sql`` is its oracle's final select."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return shown(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, replaced)
        return fn

    return register


def shown(df: DataFrame) -> DataFrame:
    """Timestamps and dates as text, so both engines compare on the same type."""
    formats = {T.TimestampType: "yyyy-MM-dd HH:mm:ss", T.TimestampNTZType: "yyyy-MM-dd HH:mm:ss",
               T.DateType: "yyyy-MM-dd"}
    return df.select([
        F.date_format(f"`{f.name}`", formats[type(f.dataType)]).alias(f.name)
        if type(f.dataType) in formats else F.col(f"`{f.name}`") for f in df.schema])


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Float sums rounded, since their last bits depend on row order."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
