"""Budget messages as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyforge.operators import billing as B
from tallyforge.operators import control as K
from tallyforge.session import settle
from tallyforge.sources.alerts import decode_budget_alerts
from tallyforge.sources.state import StateTable, load_state, save_state
from tallyforge.streaming.sink import combined, keep_state, start

MESSAGES = T.StructType([
    T.StructField("event_time", T.TimestampType()),
    T.StructField("message_id", T.LongType()),
    T.StructField("data", T.StringType()),
])

INTERVAL_COSTS = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("interval_start", T.TimestampType()),
    T.StructField("cost", T.DoubleType()),
    T.StructField("budget", T.DoubleType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("message_id", T.LongType()),
])


def read_messages(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Landed budget messages as a stream; a queue source with the same columns fits as well."""
    return (spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def stream_budget_alerts(messages: DataFrame) -> DataFrame:
    """Decoded messages, stateless."""
    return decode_budget_alerts(messages)


def spend_state(path: str) -> StateTable:
    return StateTable(path, INTERVAL_COSTS, ("project_id", "interval_start"), "year(interval_start)")


def stream_cumulative_spend(alerts: DataFrame, path: str, checkpoint: str, once: bool = True,
                            after: Callable[[int], object] | None = None) -> StreamingQuery:
    """Keep the newest cost per budget interval in the table at ``path``."""
    return keep_state(B.interval_costs(alerts), spend_state(path), checkpoint, once, after=after)


def current_spend(spark: SparkSession, path: str) -> DataFrame:
    """Cumulative spend out of the table. An older message never overwrites a newer one."""
    return B.cumulative_spend(load_state(spark, spend_state(path)))


# --- weekly throttle ------------------------------------------------------------------

class FiredWeeks(StatefulProcessor):
    """The weeks in which one kind of alert of one project has fired, the newest week and the one before.

    A week is held until one two weeks later is seen, so for 8 days after its first alert at least. The first
    row of a held or newer week fires; rows of older weeks come out marked late.
    """

    def __init__(self, columns: list[str], order: list[str]):
        self.columns, self.order = columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.weeks = handle.getListState("weeks", "monday int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {w[0] for w in self.weeks.get()}
        before = set(held)
        for r in sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order]):
            monday = date.fromisocalendar(r["iso_year"], r["iso_week"], 1).toordinal()
            late = bool(held) and monday < max(held) - 7
            if late or monday not in held:
                yield Row(**{c: r[c] for c in self.columns}, late=late)
            if not late:
                held = {w for w in held | {monday} if w >= max(held | {monday}) - 7}
        if held != before:
            self.weeks.put([(w,) for w in sorted(held)])

    def close(self) -> None:
        pass


def _first_of_each_week(rows: DataFrame, order: list[str]) -> DataFrame:
    """The earliest row per week key of what a task reads, so that few rows of a busy project meet."""
    def firsts(part: pa.Table) -> pa.Table:
        ordered = part.take(pc.sort_indices(part, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
        placed = ordered.select(K.WEEK_KEY).append_column("_place", pa.array(np.arange(ordered.num_rows)))
        return ordered.take(placed.group_by(K.WEEK_KEY).aggregate([("_place", "min")])["_place_min"])

    return rows.mapInArrow(lambda batches: combined(batches, firsts), rows.schema)


def throttled_alerts(alerts: DataFrame) -> DataFrame:
    """The alerts that fire, as a stream, with ``late``: throttled kinds once per project and ISO week, the first to arrive.

    Of a batch's alerts of one week the earliest counts as the first, of equal times the least in the other columns. The state is two weeks per project and
    kind. Whether an alert of an older week (``late``) fires is for the sink to say, which has what fired then.
    """
    dated = K.with_iso_week(alerts)
    throttled = F.col("alert").isin(*K.THROTTLED)
    order = ["event_time", *[c for c in alerts.columns if c not in ("project_id", "alert", "event_time")]]
    firsts = _first_of_each_week(dated.where(throttled), order)
    schema = T.StructType([*dated.schema.fields, T.StructField("late", T.BooleanType())])
    once = firsts.groupBy("project_id", "alert").transformWithState(FiredWeeks(dated.columns, order), schema, "Update", "None")
    return once.unionByName(dated.where(~throttled).withColumn("late", F.lit(False)))


def fired_state(path: str, alerts: DataFrame) -> StateTable:
    """The table of fired alerts, a partition for a quarter of an ISO year: a throttled kind has one row per week, others a row per alert."""
    schema = T.StructType([*K.with_iso_week(alerts).schema.fields, T.StructField("which", T.StringType())])
    return StateTable(path, schema, (*K.WEEK_KEY, "which"), _QUARTER)


_QUARTER = "concat(iso_year, '-', (iso_week - 1) div 13)"


def stream_weekly_throttle(alerts: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Add the alerts that fire to the table at ``path``.

    A late alert fires unless the table has one of its kind and week already, so
    every week has exactly one, however old. An alert that equals another in
    every column is the same alert, so repeated messages and batches add nothing.
    """
    state = fired_state(path, alerts)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = settle(batch, "fired")
        fires = rows.where("NOT late").drop("late")
        quarters = [r["q"] for r in rows.where("late").select(F.expr(_QUARTER).alias("q")).distinct().collect()]   # dates, not rows
        if quarters:
            before = load_state(spark, state, parts=quarters)
            late = K.weekly_throttle(rows.where("late").select(*alerts.columns), before)
            # a replayed batch finds its own late alerts in the table, which then stay as they are
            fires = fires.unionByName(late)
        which = F.when(F.col("alert").isin(*K.THROTTLED), "").otherwise(F.to_json(F.struct(*alerts.columns)))
        save_state(fires.withColumn("which", which).dropDuplicates([*K.WEEK_KEY, "which"]), state)

    return start(throttled_alerts(alerts), checkpoint, store, once)


def fired_alerts(spark: SparkSession, path: str, alerts: DataFrame) -> DataFrame:
    """Everything fired so far."""
    return load_state(spark, fired_state(path, alerts)).drop("which")
