"""Queries for the streaming operators.

Each streams a whole given table through Structured Streaming, in several
batches out of order and over a restart, then reads the table it maintains; the
oracle is the batch result in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import inventory as I
from tallyforge.plans import budget
from tallyforge.session import scratch_path, write_folders
from tallyforge.sources.exports import stream_billing_export
from tallyforge.sources.state import read_run
from tallyforge.streaming import alerts as SA
from tallyforge.streaming import charges as SC
from tallyforge.streaming import control as SK
from tallyforge.streaming import inventory as SI
from tallyforge.workload import adapters as A
from tallyforge.workload.landing import billing_export
from tallyforge.workload.oracle_base import NOW, OF_RUN, oracle, ts
from tallyforge.workload.q_billing import _ACTION_SQL, _ALERT_SQL, LIMITS, message_alerts, run_inputs
from tallyforge.workload.registry import query

SLICES = 5
#: Files of a slice at least; as many as a scan of the table has tasks if those are more.
FILES = 4
_DAY = 86400


def slice_of(d: A.Dialect, table: str, slices: int = SLICES) -> str:
    """The slice that a row of ``table`` lands in, from 0.

    Messages land in any order. Snapshots land by time, but every tenth one slice late.
    """
    if table == "orders":
        return f"o_orderkey % {slices}"
    days = d.div(f"{d.seconds('ts')} - 1704067200", 6 * _DAY)
    return f"least({slices - 1}, {days} + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END)"


def landed_so_far(name: str, last: int, slices: int = SLICES, first: int = 0) -> str:
    """SQL for the relation ``name`` as it is when the slices ``first`` to ``last`` have landed."""
    build, (table, *_) = A.FLAT[name]
    return build(A.of_some(table, f"{slice_of(A.Duck, table, slices)} BETWEEN {first} AND {last}"))


class Landing:
    """A given table landed in slices, each so many files that the stream takes as one batch, with one restart.

    The last slice comes after the restart, and with ``repeats`` a tenth of all
    rows once more.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, name: str, repeats: bool, slices: int = SLICES):
        self.spark, self.name, self.repeats, self.slices = spark, name, repeats, slices
        self.table = A.FLAT[name][1][0]
        self.rows = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        self.files = max(FILES, self.rows.rdd.getNumPartitions())
        self.path = scratch_path(spark, f"{self.table}-landed")
        self.waiting = scratch_path(spark, f"{self.table}-slices")
        write_folders(self.rows.withColumn("_slice", F.expr(slice_of(A.Spark, self.table, slices)).cast("int")), self.waiting, ("_slice",))

    def stream(self) -> DataFrame:
        source = self.spark.readStream.schema(self.rows.schema).option("maxFilesPerTrigger", self.files).parquet(self.path)
        return self.spark.sql(A.FLAT[self.name][0](A.Spark), **{self.table: source})

    def run(self, start) -> None:
        """``start()`` starts the query, which stops when it has read what is there."""
        for k in range(self.slices):
            if k == self.slices - 1:
                start().awaitTermination()
            new = self.spark.read.schema(self.rows.schema).parquet(f"{self.waiting}/_slice={k}")
            new.repartition(self.files).write.mode("append").parquet(self.path)
        if self.repeats:
            again = self.rows.where(F.pmod(F.xxhash64(F.lit("again"), *self.rows.columns), F.lit(10)) == 0)
            again.repartition(self.files).write.mode("append").parquet(self.path)
        start().awaitTermination()


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    base = scratch_path(spark, name)
    return f"{base}/state", f"{base}/checkpoint"


def _messages(spark: SparkSession, sf_dir: str, slices: int = SLICES) -> tuple[Landing, Callable[[], DataFrame]]:
    landing = Landing(spark, sf_dir, "alerts_flat", repeats=True, slices=slices)
    # the folder exists once the first files are there, so the stream is declared when it starts
    return landing, lambda: SA.stream_budget_alerts(A.encoded_alerts(landing.stream()))


@query("stream_budget_alerts", f"""SELECT {ts('event_time')}, message_id, project_id, {ts('interval_start')}, cost, budget
  FROM alerts_flat""")
def stream_budget_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateless: every message once, so nothing is repeated here."""
    path, checkpoint = _paths(spark, "alert-stream")
    landing = Landing(spark, sf_dir, "alerts_flat", repeats=False)
    decoded = lambda: SA.stream_budget_alerts(A.encoded_alerts(landing.stream()))
    landing.run(lambda: decoded().writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    return spark.read.schema(decoded().schema).parquet(path)


@query("stream_cumulative_spend", "SELECT * FROM spend")
def stream_cumulative_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = _paths(spark, "spend-stream")
    landing, messages = _messages(spark, sf_dir)
    landing.run(lambda: SA.stream_cumulative_spend(messages(), path, checkpoint))
    return SA.current_spend(spark, path)


# --- the controller -----------------------------------------------------------------

_FIRST_HALF = {**OF_RUN, "alerts_flat": landed_so_far("alerts_flat", 0, slices=2)}
_CONTROLLED: dict[tuple[str, str], str] = {}


def _controlled(spark: SparkSession, sf_dir: str) -> str:
    """Two controller runs within a week, each over all messages so far; the folder of their tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CONTROLLED:
        path, checkpoint = _paths(spark, "control-stream")
        out = scratch_path(spark, "controlled")
        landing, messages = _messages(spark, sf_dir, slices=2)
        inputs = run_inputs(spark, sf_dir)
        landing.run(lambda: SK.stream_control(
            messages(), path, checkpoint,
            lambda spend, run: budget.control_run(inputs, A.AS_OF + timedelta(minutes=run), LIMITS, out, run, spend=spend)))
        _CONTROLLED[key] = out
    return _CONTROLLED[key]


def _runs(spark: SparkSession, out: str, name: str, schema: str) -> DataFrame:
    both = [read_run(spark, f"{out}/{name}", run, spark.createDataFrame([], schema).schema).withColumn("run", F.lit(run)) for run in (0, 1)]
    return both[0].unionByName(both[1])


@query("stream_control", f"""SELECT CAST(0 AS INTEGER) AS run, project_id, action FROM ({oracle(_ACTION_SQL, _FIRST_HALF)})
  UNION ALL SELECT CAST(1 AS INTEGER), project_id, action FROM ({oracle(_ACTION_SQL, OF_RUN)})""")
def stream_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the two runs decides for every project."""
    return _runs(spark, _controlled(spark, sf_dir), "actions", "project_id string, action string")


@query("stream_control_alerts", f"""SELECT CAST(min(run) AS INTEGER) AS run, project_id, alert FROM (
    SELECT 0 AS run, project_id, alert FROM ({oracle(_ALERT_SQL, _FIRST_HALF)})
    UNION ALL SELECT 1, project_id, alert FROM ({oracle(_ALERT_SQL, OF_RUN)})) AS raised
  GROUP BY project_id, alert, CASE WHEN alert IN ('3', '4') THEN run END""")
def stream_control_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run is silent about what the first has said this week."""
    year, week, _ = A.AS_OF.isocalendar()
    return _runs(spark, _controlled(spark, sf_dir), f"alerts/iso_year={year}/iso_week={week}", "project_id string, alert string")


# --- throttle -----------------------------------------------------------------------

def _arrivals(name: str) -> str:
    """The relation's rows with the slice they came in."""
    return " UNION ALL ".join(f"SELECT *, {k} AS slice FROM ({landed_so_far(name, k, first=k)})" for k in range(SLICES))


@query("stream_weekly_throttle", f"""WITH arrived AS ({_arrivals('alerts_flat')}),
  raised AS (SELECT slice, project_id, '2' AS alert, event_time, cost AS value, message_id FROM arrived WHERE cost > 0.008 * budget
    UNION ALL SELECT slice, project_id, '4', event_time, cost, message_id FROM arrived WHERE cost > 0.02 * budget)
  SELECT project_id, alert, {ts('event_time')}, value, message_id, CAST(iso_year AS INTEGER) AS iso_year, CAST(iso_week AS INTEGER) AS iso_week
  FROM (SELECT *, isoyear(event_time) AS iso_year, weekofyear(event_time) AS iso_week, row_number() OVER (
    PARTITION BY project_id, alert, isoyear(event_time), weekofyear(event_time) ORDER BY slice, event_time, value, message_id) AS rn FROM raised)
  WHERE alert <> '2' OR rn = 1""")
def stream_weekly_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = _paths(spark, "throttle-stream")
    landing, messages = _messages(spark, sf_dir)
    landing.run(lambda: SA.stream_weekly_throttle(message_alerts(messages()), path, checkpoint))
    return SA.fired_alerts(spark, path, message_alerts(messages()))


# --- machines -----------------------------------------------------------------------

#: Snapshots come up to a slice late; a machine is gone after five days without one.
LATENESS, ABSENT = timedelta(days=7), timedelta(days=5)

# A batch sees the watermark of the newest snapshot in the batches before it. One without data follows at the end of
# each start, so the last two slices' watermarks take effect at once and those before with the batch after the next.

_LISTED_SNAPSHOTS = f"""WITH arrived AS ({_arrivals('snapshots_flat')}),
  seen AS (SELECT project_id, vm_id, slice, max(newest) OVER (PARTITION BY project_id, vm_id ORDER BY slice) AS last_seen,
    lead(slice) OVER (PARTITION BY project_id, vm_id ORDER BY slice) AS following
    FROM (SELECT project_id, vm_id, slice, max(inventory_time) AS newest FROM arrived GROUP BY ALL)),
  newest AS (SELECT slice, max(newest) OVER (ORDER BY slice) - INTERVAL {LATENESS.days} DAY AS watermark
    FROM (SELECT slice, max(inventory_time) AS newest FROM arrived GROUP BY ALL)),
  gone AS (SELECT project_id, vm_id, max(s.slice) AS gone_after FROM seen AS s JOIN newest AS n
    ON n.slice = CASE WHEN following IS NULL THEN {SLICES - 1} WHEN following = {SLICES - 1} THEN following - 1 ELSE following - 2 END
    WHERE n.watermark > s.last_seen + INTERVAL {ABSENT.days} DAY GROUP BY ALL)
  SELECT a.* EXCLUDE (slice) FROM arrived AS a LEFT JOIN gone AS g USING (project_id, vm_id) WHERE a.slice > coalesce(g.gone_after, -1)"""


@query("stream_vm_uptime", f"SELECT project_id, vm_id, {ts('start')}, {ts('stop')} FROM intervals",
       replaced={"snapshots_flat": _LISTED_SNAPSHOTS})
def stream_vm_uptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A machine has the history since it was last new to the listing; one that left it has none."""
    path, checkpoint = _paths(spark, "uptime-stream")
    landing = Landing(spark, sf_dir, "snapshots_flat", repeats=False)
    landing.run(lambda: SI.stream_vm_uptime(landing.stream(), path, checkpoint, f"{LATENESS.days} days", ABSENT))
    return SI.current_intervals(spark, path)


# --- charges ------------------------------------------------------------------------

def _dated_export(spark: SparkSession, sf_dir: str, start: Callable[[DataFrame], object]) -> None:
    """The billing export arriving by date, dates in mixed order; ``start(stream)`` starts the query each time."""
    export = billing_export(spark, sf_dir)
    path = scratch_path(spark, "export-landed")
    dates = sorted(r["export_date"] for r in export.select("export_date").distinct().collect())
    for k in range(SLICES):
        new = [d for i, d in enumerate(dates) if i * 3 % SLICES == k]
        write_folders(export.where(F.col("export_date").isin(new)), path, ("export_date",), "append")
        start(stream_billing_export(spark, path)).awaitTermination()


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exported row is a charge of its own, so none is repeated."""
    path, checkpoint = _paths(spark, "charge-stream")
    _dated_export(spark, sf_dir, lambda stream: SC.stream_hourly_charges(stream, path, checkpoint))
    return SC.current_hourly_charges(spark, path)


_HOURLY_SQL = """SELECT project_id, sku_id, sku_description, date_trunc('hour', usage_start_time) AS usage_hour,
  CAST(sum(CAST(cost AS DECIMAL(28, 9))) AS DOUBLE) AS total_cost, min(export_time) AS first_export,
  max(export_time) AS last_export FROM billing_flat WHERE cost > 0.00001 GROUP BY ALL"""


@query("stream_hourly_charges", f"""SELECT project_id, sku_id, sku_description, {ts('usage_hour')}, total_cost, {ts('first_export')},
  {ts('last_export')} FROM ({_HOURLY_SQL})""")
def stream_hourly_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(spark, sf_dir)


@query("stream_windowed_charges", f"""SELECT project_id, sku_id, sku_description, {ts('usage_hour')}, total_cost, {ts('first_export')},
  {ts('last_export')} FROM ({_HOURLY_SQL})""")
def stream_windowed_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a watermark wider than the ten days of the data, so every row is on time."""
    path, checkpoint = _paths(spark, "window-stream")
    _dated_export(spark, sf_dir, lambda stream: SC.stream_windowed_charges(stream, path, checkpoint, lateness="20 days"))
    return SC.current_windowed_charges(spark, path)


@query("retain_13_hours", f"""SELECT project_id, sku_id, {ts('usage_hour')}, total_cost FROM ({_HOURLY_SQL})
  WHERE usage_hour >= date_trunc('hour', {NOW}) - INTERVAL 12 HOUR""")
def retain_13_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.retain_13_hours(_hourly(spark, sf_dir), A.AS_OF).select("project_id", "sku_id", "usage_hour", "total_cost")
