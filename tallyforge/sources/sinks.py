"""Sinks: price tables and the cost log."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_price_table(df: DataFrame, target: str) -> DataFrame:
    """Replace the target table (or Parquet path) with ``df`` and read it back."""
    spark = df.sparkSession
    if "/" in target:
        df.write.mode("overwrite").parquet(target)
        return spark.read.schema(df.schema).parquet(target)
    df.write.mode("overwrite").saveAsTable(target)
    return spark.table(target)


def write_cost_log(lines: DataFrame, path: str) -> None:
    """Append status lines (column ``line``) as text."""
    lines.select("line").write.mode("append").text(path)
