"""Streams in several out-of-order batches, with repeats and restarts, against batch results."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators import billing as B
from tallyforge.operators import inventory as I
from tallyforge.sources.exports import stream_billing_export
from tallyforge.operators import control as K
from tallyforge.session import session_conf
from tallyforge.streaming import alerts as SA
from tallyforge.streaming import charges as SC
from tallyforge.streaming import inventory as SI
from tallyforge.streaming import sink
from tallyforge.workload import q_streaming
from tallyforge.workload.adapters import encoded_alerts

UTC = timezone.utc
T0 = datetime(2020, 12, 20, tzinfo=UTC)
ALERT = "project_id string, interval_start timestamp, cost double, budget double, event_time timestamp, message_id long"


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def messages(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        at = T0 + timedelta(hours=i)
        rows.append((f"p{rng.randrange(3)}", at.replace(day=1, hour=0), float(rng.randrange(1000)), 100.0 + i % 7, at, i))
    rng.shuffle(rows)
    return rows


def test_messages_to_spend(spark, messages, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "state", "checkpoint"))
    land = lambda rows: encoded_alerts(spark.createDataFrame(rows, ALERT)).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: SA.stream_cumulative_spend(
        SA.stream_budget_alerts(SA.read_messages(spark, source, files_per_trigger=1)), table, checkpoint).awaitTermination()
    for k in range(3):
        land(messages[k::4])
    stream()
    land(messages[3::4])
    land(messages[:50])  # repeated messages
    stream()             # restart from the checkpoint
    batch = B.cumulative_spend(B.interval_costs(spark.createDataFrame(messages, ALERT)))
    same(SA.current_spend(spark, table), batch)


def test_throttle_fires_once_per_week(spark, messages, tmp_path):
    """Whatever the order: late weeks are looked up, and the first to arrive fires."""
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "fired", "checkpoint"))
    kinds = lambda df: df.select("project_id", F.when(F.col("cost") > 500, "2").otherwise("4").alias("alert"), "event_time",
                                 F.col("cost").alias("value"), "message_id")
    stream = lambda: kinds(SA.stream_budget_alerts(SA.read_messages(spark, source, files_per_trigger=1)))
    by_time = sorted(messages, key=lambda m: m[4])
    slices = [by_time[200:], by_time[:120], by_time[120:200], by_time[:30], by_time[100:]]
    for k, rows in enumerate(slices):
        encoded_alerts(spark.createDataFrame(rows, ALERT)).coalesce(1).write.mode("append").parquet(source)
        if k in (2, 4):
            progress = SA.stream_weekly_throttle(stream(), table, checkpoint)
            progress.awaitTermination()
    fired = SA.fired_alerts(spark, table, stream()).collect()
    want, seen = [], set()
    for rows in slices:
        for project, _, cost, _, at, number in sorted(rows, key=lambda m: m[4]):
            year, week, _ = at.isocalendar()
            key = (project, "2", year, week) if cost > 500 else (project, "4", number)
            if key not in seen:
                seen.add(key)
                want.append((project, key[1], at, cost, number, year, week))
    got = [(r["project_id"], r["alert"], r["event_time"].astimezone(UTC), r["value"], r["message_id"], r["iso_year"], r["iso_week"]) for r in fired]
    assert sorted(got) == sorted(want)


def test_throttle_state_is_two_weeks(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "fired")
    for week in range(10):
        rows = [("p", T0, 900.0 + h, 100.0, T0 + timedelta(weeks=week, hours=h), week * 100 + h) for h in range(0, 160, 20)]
        encoded_alerts(spark.createDataFrame(rows, ALERT)).coalesce(1).write.mode("append").parquet(source)
    alerts = SA.stream_budget_alerts(SA.read_messages(spark, source, files_per_trigger=1)).select(
        "project_id", F.lit("2").alias("alert"), "event_time", "message_id")
    query = SA.stream_weekly_throttle(alerts, table, str(tmp_path / "checkpoint"))
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(rows) == 10 and max(rows) <= 3
    assert SA.fired_alerts(spark, table, alerts).count() in (10, 11)      # ten spans of a week touch eleven ISO weeks at most


def test_uptime_out_of_order(spark, tmp_path):
    """Machines that stay listed have the batch history; one that leaves loses its state and its intervals."""
    from test_inventory import SNAP, history

    rng = random.Random(23)
    rows = sorted((r for i in range(12) for r in history(rng, f"vm{i}", 500)), key=lambda r: r[2])
    last = rows[-1][2]
    mid = rows[len(rows) // 2][2]
    gone = {"vm3", "vm7"}
    rows = [r for r in rows if r[1] not in gone or r[2] < mid]
    late = [r for r in rows if rng.random() < 0.1]
    source, table = str(tmp_path / "in"), str(tmp_path / "intervals")
    step = -(-len(rows) // 5)
    for k in range(6):
        part = [r for r in rows[k * step:(k + 1) * step] if r not in late] + [r for r in rows[max(0, k - 1) * step:k * step] if r in late]
        spark.createDataFrame(part + part[:9], SNAP).coalesce(1).write.mode("append").parquet(source)
    span = (rows[-1][2] - rows[0][2]) / 5
    stream = spark.readStream.schema(spark.createDataFrame(rows, SNAP).schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = SI.stream_vm_uptime(stream, table, str(tmp_path / "checkpoint"), f"{int(span.total_seconds() * 1.5)} seconds",
                                timedelta(seconds=int(span.total_seconds() * 0.5)))
    query.awaitTermination()
    assert last - mid > 2 * span
    listed = spark.createDataFrame([r for r in rows if r[1] not in gone], SNAP)
    same(SI.current_intervals(spark, table), I.uptime_intervals(listed))
    operators = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(o["numRowsDroppedByWatermark"] for o in operators) == 0
    assert operators[-1]["numRowsTotal"] < max(o["numRowsTotal"] for o in operators)


def test_gone_machine_begins_anew(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "intervals")
    columns = "project_id string, vm_id string, inventory_time timestamp, status string, started timestamp, last_stop timestamp"
    day = lambda n: T0 + timedelta(days=n)
    for rows in ([("p", "a", day(1), "RUNNING", day(0), None), ("p", "b", day(1), "RUNNING", day(0), None)],
                 [("p", "b", day(9), "RUNNING", day(0), None)],
                 [("p", "b", day(10), "RUNNING", day(0), None)],
                 [("p", "b", day(20), "RUNNING", day(0), None), ("p", "a", day(20), "RUNNING", day(18), day(15))]):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.createDataFrame([], columns).schema).option("maxFilesPerTrigger", 1).parquet(source)
    SI.stream_vm_uptime(stream, table, str(tmp_path / "checkpoint"), "1 hour", timedelta(days=7)).awaitTermination()
    got = {(r["vm_id"], r["start"].astimezone(UTC), r["stop"]) for r in SI.current_intervals(spark, table).collect()}
    # a's first run went with it; b was listed within a week each time but the last, when it came back in time
    assert got == {("a", day(18), None), ("b", day(0), None)}


def test_hourly_charges_take_late_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    states = []

    def land(*rows):
        data = [(("p", "P"), ("Compute",), ("S", "text"), cost, (1.0, "hour"), ("202012",), start, start + timedelta(hours=1),
                 start + timedelta(hours=5), start.date()) for cost, start in rows]
        spark.createDataFrame(data, schemas.BILLING_EXPORT).write.mode("append").partitionBy("export_date").parquet(source)
        for kind, start_stream in (("exact", SC.stream_hourly_charges),
                                   ("window", lambda *a: SC.stream_windowed_charges(*a, lateness="2 days"))):
            query = start_stream(stream_billing_export(spark, source), str(tmp_path / kind), str(tmp_path / f"{kind}-checkpoint"))
            query.awaitTermination()
            if kind == "exact":
                states.extend(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])

    def totals(df):
        return {r["usage_hour"].astimezone(UTC): r["total_cost"] for r in df.collect()}

    land((1.0, T0), (2.0, T0 + timedelta(minutes=10)), (0.000001, T0))
    land((4.0, T0 + timedelta(hours=30)), (8.0, T0))            # late by 30 hours
    land((16.0, T0 + timedelta(hours=90)))                       # a date that was not there before
    land((32.0, T0))                                             # late by more than the two days
    land(*[(1.0, T0 + timedelta(hours=100 + h)) for h in range(0, 200, 5)])
    later = {T0 + timedelta(hours=30): 4.0, T0 + timedelta(hours=90): 16.0}
    many = {T0 + timedelta(hours=100 + h): 1.0 for h in range(0, 200, 5)}
    assert totals(SC.current_hourly_charges(spark, str(tmp_path / "exact"))) == {T0: 43.0, **later, **many}
    assert totals(SC.late_charges(spark, str(tmp_path / "exact"))) == {T0: 32.0}
    assert totals(SC.current_windowed_charges(spark, str(tmp_path / "window"))) == {T0: 11.0, **later, **many}
    assert max(states) <= 50 and states[-1] <= 10                # the hours of two days, whatever came before


def test_batches_cost_the_same(spark, tmp_path):
    """Over 30 batches each of a new day, a batch rewrites its own day only, and the state keeps its size."""
    source, table = str(tmp_path / "in"), str(tmp_path / "hours")
    for d in range(30):
        rows = [(("p", "P"), ("Compute",), (f"S{i}", "text"), 1.0, (1.0, "hour"), ("202012",), at, at, at, at.date())
                for i in range(5) for at in [T0 + timedelta(days=d, hours=i)]]
        spark.createDataFrame(rows, schemas.BILLING_EXPORT).coalesce(1).write.mode("append").partitionBy("export_date").parquet(source)
    query = SC.stream_hourly_charges(stream_billing_export(spark, source, files_per_trigger=1), table, str(tmp_path / "checkpoint"))
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(rows) == 30 and max(rows[5:]) == rows[4]
    times = {d.name: max(f.stat().st_mtime for f in d.iterdir()) for d in (tmp_path / "hours" / "hours" / "rows").glob("part=*")}
    assert len(times) == 30 and [times[d] for d in sorted(times)] == sorted(times.values())
    assert SC.current_hourly_charges(spark, table).count() == 150


def test_control_decides_after_each_batch(spark, messages, tmp_path):
    from tallyforge.sources.state import read_run, save_run
    from tallyforge.streaming.control import stream_control

    source = str(tmp_path / "in")
    for k in range(2):
        encoded_alerts(spark.createDataFrame(messages[k::2], ALERT)).coalesce(1).write.mode("append").parquet(source)
    decided = str(tmp_path / "decided")
    stream_control(SA.stream_budget_alerts(SA.read_messages(spark, source, files_per_trigger=1)), str(tmp_path / "state"),
                   str(tmp_path / "checkpoint"), lambda spend, run: save_run(spend, decided, run)).awaitTermination()
    batch = B.cumulative_spend(B.interval_costs(spark.createDataFrame(messages, ALERT)))
    assert sorted(p.name for p in (tmp_path / "decided").iterdir()) == ["version=0", "version=1"]
    same(read_run(spark, decided, 1, batch.schema), batch)


def test_first_of_equal_times_is_the_least_value(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "fired")
    columns = "project_id string, alert string, event_time timestamp, value double, message_id long"
    rows = [("p", "2", T0, 10.0, 1), ("p", "2", T0, 9.0, 2), ("q", "2", T0, 100.0, 3), ("q", "2", T0, None, 4)]
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(source)
    alerts = spark.readStream.schema(columns).parquet(source)
    SA.stream_weekly_throttle(alerts, table, str(tmp_path / "checkpoint")).awaitTermination()
    fired = {(r["project_id"], r["message_id"]) for r in SA.fired_alerts(spark, table, alerts).collect()}
    assert fired == {("p", 2), ("q", 4)} == {(r["project_id"], r["message_id"]) for r in K.weekly_throttle(spark.createDataFrame(rows, columns)).collect()}


def test_task_combines_its_rows_over_all_batches(spark):
    rows = [(("p", "P"), ("Compute",), ("S", "text"), 1.0, (1.0, "hour"), ("202012",), T0, T0, T0, T0.date()) for _ in range(500)]
    with session_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "20"):
        got = SC.hour_parts(spark.createDataFrame(rows, schemas.BILLING_EXPORT).coalesce(1)).collect()
    assert [float(r["total_cost"]) for r in got] == [500.0]


def test_combining_goes_on_when_few_rows_can_be_combined(monkeypatch):
    monkeypatch.setattr(sink, "HELD", 10)
    sums = lambda t: t.group_by("k").aggregate([("n", "sum")]).rename_columns(["k", "n"])
    batches = [pa.record_batch({"k": [b * 4 + i for i in range(4)] + [0], "n": [1] * 5}) for b in range(30)]
    out = list(sink.combined(iter(batches), sums))
    total = sums(pa.Table.from_batches(out)).to_pydict()
    assert len(out) > 1 and dict(zip(total["k"], total["n"])) == {0: 31, **{k: 1 for k in range(1, 120)}}


def test_large_tables_land_in_more_files(spark, tmp_path):
    spark.range(0, 100, 1, 7).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    with session_conf(spark, "spark.sql.files.openCostInBytes", "134217728"):
        landing = q_streaming.Landing(spark, str(tmp_path), "alerts_flat", repeats=False)
        assert landing.files == 7


def test_uptime_state_is_one_row_per_group(spark, tmp_path):
    """Machines of one group leave one by one, each as of its own last listing."""
    source, table = str(tmp_path / "in"), str(tmp_path / "intervals")
    columns = "project_id string, vm_id string, inventory_time timestamp, status string, started timestamp, last_stop timestamp"
    day = lambda n: T0 + timedelta(days=n)
    seen = lambda vm, n: ("p", f"vm{vm}", day(n), "RUNNING", day(vm % 2), None)
    # vm0 to vm9 are listed last on day 1, vm10 to vm19 on day 6, vm20 to vm39 on days 12 and 14 as well
    for rows in ([seen(i, 1) for i in range(40)], [seen(i, 6) for i in range(10, 40)], [seen(i, 12) for i in range(20, 40)],
                 [seen(i, 14) for i in range(20, 40)]):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(source)
    query = SI.stream_vm_uptime(stream, table, str(tmp_path / "checkpoint"), "1 hour", timedelta(days=7), groups=2)
    query.awaitTermination()
    assert {r["vm_id"] for r in SI.current_intervals(spark, table).collect()} == {f"vm{i}" for i in range(20, 40)}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) < 20
