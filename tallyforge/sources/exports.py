"""Scans of the two provider exports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions.keys import instant


def scan_sku_export(spark: SparkSession, path: str) -> DataFrame:
    """Nested SKU price export. Only the struct fields a query uses are read."""
    return spark.read.parquet(path)


def stream_billing_export(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The billing export as a stream over its date folders; dates that appear later are found while it runs."""
    return spark.readStream.schema(schemas.BILLING_EXPORT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scan_billing_export(
    source: SparkSession | DataFrame,
    as_of: datetime,
    lookback: timedelta | None = timedelta(days=2),
    path: str | None = None,
) -> DataFrame:
    """Charges exported in the lookback before ``as_of``.

    ``export_date`` is the partition column. The bound on it is a literal, so
    partitions outside the lookback are never listed as scan input. Charges
    exported after ``as_of`` were not there yet and are left out.
    """
    billing = source.read.parquet(path) if isinstance(source, SparkSession) else source
    seen = billing.where(
        (F.col("export_date") <= F.lit(as_of.date())) & (F.col("export_time") <= instant(as_of)))
    if lookback is None:
        return seen
    # midnight of a date is later than the bound exactly when the date is later than the bound's date
    return seen.where(F.col("export_date") > F.lit((as_of - lookback).date()))
