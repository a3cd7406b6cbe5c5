"""Hourly charges from a stream of exported rows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from decimal import Decimal

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyforge import constants as C
from tallyforge.functions.keys import money
from tallyforge.session import settle
from tallyforge.sources.state import StateTable, load_state, save_state
from tallyforge.streaming.sink import combined, keep_state, start

HOURLY = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("sku_id", T.StringType()),
    T.StructField("sku_description", T.StringType()),
    T.StructField("usage_hour", T.TimestampType()),
    T.StructField("total_cost", T.DoubleType()),
    T.StructField("first_export", T.TimestampType()),
    T.StructField("last_export", T.TimestampType()),
])
_COST = T.DecimalType(38, 9)
SUMS = T.StructType([T.StructField(f.name, _COST) if f.name == "total_cost" else f for f in HOURLY])
LATE = T.StructType([*SUMS.fields, T.StructField("usage_date", T.DateType()), T.StructField("batch", T.LongType())])
_SKU = ["project_id", "sku_id", "sku_description"]
_KEYS = [*_SKU, "usage_hour"]
_VALUES = [("total_cost", _COST), ("first_export", T.LongType()), ("last_export", T.LongType())]
#: An open hour in the state, or a change of an hour; times are microseconds.
_HOUR = T.StructType([T.StructField("usage_hour", T.LongType()), *[T.StructField(n, t) for n, t in _VALUES]])
_CHANGED = T.StructType([*SUMS.fields[:3], *_HOUR.fields, T.StructField("late", T.BooleanType())])


def _rows(billing: DataFrame, min_charge: float) -> DataFrame:
    return billing.where(F.col("cost") > F.lit(min_charge)).select(
        F.col("project.id").alias("project_id"), F.col("sku.id").alias("sku_id"),
        F.col("sku.description").alias("sku_description"), "usage_start_time", "export_time", money("cost").alias("cost"))


def hour_parts(billing: DataFrame, min_charge: float = C.MIN_CHARGE) -> DataFrame:
    """Exact sums per SKU and usage hour of what a task reads, so that few rows of a busy SKU meet; times in microseconds."""
    hour = F.unix_micros(F.date_trunc("hour", "usage_start_time"))
    rows = _rows(billing, min_charge).select(
        *_SKU, hour.alias("usage_hour"), F.col("cost").cast(_COST).alias("total_cost"),
        F.unix_micros("export_time").alias("first_export"), F.unix_micros("export_time").alias("last_export"))

    def combine(part: pa.Table) -> pa.Table:
        sums = part.group_by(_KEYS).aggregate([("total_cost", "sum"), ("first_export", "min"), ("last_export", "max")])
        return sums.select([*_KEYS, "total_cost_sum", "first_export_min", "last_export_max"]).rename_columns(
            part.schema.names).cast(part.schema)

    return rows.mapInArrow(lambda batches: combined(batches, combine), rows.schema)


class OpenHours(StatefulProcessor):
    """The hours of one SKU of a project that may still get charges.

    An hour is open until usage ``lateness`` after it was seen. Changes of open
    hours come out as whole values; charges of closed hours as what they add, marked late.
    """

    def __init__(self, lateness: timedelta):
        self.lateness = lateness // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hours = handle.getListState("hours", _HOUR)

    @staticmethod
    def _add(hours: dict, hour: int, cost: Decimal, first: int, last: int) -> None:
        have = hours.get(hour)
        hours[hour] = (cost, first, last) if have is None else (have[0] + cost, min(have[1], first), max(have[2], last))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        hours = {h[0]: tuple(h[1:]) for h in self.hours.get()}
        newest = max(hours, default=None)
        closed = None if newest is None else newest - self.lateness
        changed, late = set(), {}
        for r in rows:
            hour = r["usage_hour"]
            is_late = closed is not None and hour < closed
            self._add(late if is_late else hours, hour, r["total_cost"], r["first_export"], r["last_export"])
            if not is_late:
                changed.add(hour)
        for hours_of, late_ones in ((sorted(changed), False), (sorted(late), True)):
            for hour in hours_of:
                cost, first, last = (late if late_ones else hours)[hour]
                yield Row(project_id=key[0], sku_id=key[1], sku_description=key[2], usage_hour=hour, total_cost=cost,
                          first_export=first, last_export=last, late=late_ones)
        if changed:
            still = max(hours) - self.lateness
            self.hours.put([(hour, *values) for hour, values in sorted(hours.items()) if hour >= still])

    def close(self) -> None:
        pass


def hourly_state(path: str) -> StateTable:
    return StateTable(f"{path}/hours", SUMS, tuple(_KEYS), "date_format(usage_hour, 'yyyy-MM-dd')")


def stream_hourly_charges(billing: DataFrame, path: str, checkpoint: str, lateness: timedelta = timedelta(days=2),
                          once: bool = True) -> StreamingQuery:
    """Keep the total of every hour below ``path``; no row is too late.

    Reports trail usage by half a day and more. The state of a SKU has the hours
    of the last ``lateness`` before its newest usage, however long the stream
    runs; their totals are kept in a state table. Charges of earlier hours go to a side table,
    by date and batch, which readers add.
    """
    changed = hour_parts(billing).groupBy(*_SKU).transformWithState(OpenHours(lateness), _CHANGED, "Update", "None")
    timed = changed.withColumns({c: F.timestamp_micros(c) for c in ("usage_hour", "first_export", "last_export")})

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = settle(batch, "hour-changes")
        save_state(rows.where("NOT late").drop("late"), hourly_state(path))
        late = rows.where("late").select(*SUMS.names, F.to_date("usage_hour").alias("usage_date"), F.lit(batch_id).cast("long").alias("batch"))
        late.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("usage_date", "batch").parquet(f"{path}/late")

    return start(timed, checkpoint, store, once)


def late_charges(spark: SparkSession, path: str) -> DataFrame:
    """What came after its hour was closed."""
    try:
        return spark.read.schema(LATE).parquet(f"{path}/late")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LATE)


def current_hourly_charges(spark: SparkSession, path: str) -> DataFrame:
    """Hourly totals as of the last batch, late charges included."""
    rows = load_state(spark, hourly_state(path)).unionByName(late_charges(spark, path).select(*SUMS.names))
    return rows.groupBy(*_KEYS).agg(
        F.sum("total_cost").cast("double").alias("total_cost"), F.min("first_export").alias("first_export"),
        F.max("last_export").alias("last_export"))


# --- preview ------------------------------------------------------------------------

def windowed_charges(billing: DataFrame, lateness: str, min_charge: float = C.MIN_CHARGE) -> DataFrame:
    """A preview of the same totals on Spark's windows, for consumers that want changes at once.

    An hour stays open for ``lateness`` after the newest usage seen, then its
    state is released and later rows are missing here; only
    ``stream_hourly_charges`` has them all. There is no default: whoever asks
    for a preview says what it may miss.
    """
    hour = F.window("usage_start_time", "1 hour")
    summed = _rows(billing, min_charge).withWatermark("usage_start_time", lateness).groupBy(
        "project_id", "sku_id", "sku_description", hour).agg(
        F.sum("cost").alias("_cost"), F.min("export_time").alias("first_export"),
        F.max("export_time").alias("last_export"))
    return summed.select("project_id", "sku_id", "sku_description", F.col("window.start").alias("usage_hour"),
                         F.col("_cost").cast("double").alias("total_cost"), "first_export", "last_export")


def preview_state(path: str) -> StateTable:
    return StateTable(path, HOURLY, tuple(_KEYS), "date_format(usage_hour, 'yyyy-MM-dd')")


def stream_windowed_charges(billing: DataFrame, path: str, checkpoint: str, lateness: str, once: bool = True) -> StreamingQuery:
    """Keep each open hour's total so far in the table at ``path``."""
    return keep_state(windowed_charges(billing, lateness), preview_state(path), checkpoint, once)


def current_windowed_charges(spark: SparkSession, path: str) -> DataFrame:
    """Hourly totals as last emitted."""
    return load_state(spark, preview_state(path))
