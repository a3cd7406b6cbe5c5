"""Charges, reconciliation, budget and alerts on hand-made rows."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest

from tallyforge import schemas
from tallyforge.operators import billing as B
from tallyforge.operators import control as K
from tallyforge.sources import state
from tallyforge.sources.exports import scan_billing_export

UTC = timezone.utc
AS_OF = datetime(2024, 1, 20, 12, 34, 56)
NOW = AS_OF.replace(tzinfo=UTC)


def charge(project="p", sku="S", text="Instance Core", cost=1.0, start=datetime(2024, 1, 20, 5, tzinfo=UTC), hours=1,
           lag=2, service="Compute", usage=1.0):
    end = start + timedelta(hours=hours)
    export = end + timedelta(hours=lag)
    return ((project, project.upper()), (service,), (sku, text), cost, (usage, "gibibyte"), (start.strftime("%Y%m"),),
            start, end, export, export.date())


def billing(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.BILLING_EXPORT)


def test_egress(spark):
    df = billing(spark, charge(text="Download Worldwide", cost=0.209, usage=2.7395823346450907),
                 charge(text="Inter-region egress", cost=0.0224, usage=2.739579800516365),
                 charge(text="Download Worldwide", cost=0.001), charge(), charge(project="q"))
    rows = B.egress_costs(df).collect()
    assert [(r["sku"], r["total_cost"]) for r in rows] == [("Download Worldwide", 0.21), ("Inter-region egress", 0.0224)]
    projects = spark.createDataFrame([("p",), ("q",)], "project_id string")
    assert {tuple(r) for r in B.egress_total(df, projects).collect()} == {("p", 0.2324), ("q", 0.0)}


def test_last_charges_keep_ties_at_the_boundary(spark):
    at = lambda h: datetime(2024, 1, 20, h, tzinfo=UTC)
    rows = [charge(start=at(h), cost=h + 1.0, lag=1) for h in range(6)]
    # a second slot with the same end as the fourth newest: both have rank 4
    rows.append(charge(start=at(1), hours=2, cost=9.0, lag=1))
    rows.append(charge(start=at(5), cost=0.5, lag=3))         # another export of the newest slot
    rows.append(charge(start=at(5), cost=0.00001, lag=3))     # at the minimum: ignored
    rows.append(charge(start=at(6), cost=5.0, lag=30))        # not exported yet
    rows.append(charge(start=at(1) - timedelta(days=4), sku="OLD"))  # before the lookback
    seen = scan_billing_export(billing(spark, *rows), AS_OF)
    got = B.last_n_charges(seen, AS_OF).collect()
    assert [(r["usage_start_time"].astimezone(UTC).hour, r["rank"], r["total_cost"]) for r in got] == [
        (5, 1, 6.5), (4, 2, 5.0), (3, 3, 4.0), (2, 4, 3.0), (1, 4, 9.0)]
    assert got[0]["delay_seconds"] == 6 * 3600 + 34 * 60 + 56
    assert (got[0]["last_export"] - got[0]["first_export"]) == timedelta(hours=2)
    burn = B.estimate_burn_from_history(B.charge_history(B.last_n_charges(seen, AS_OF))).first()
    assert (burn["slots"], burn["slot_cost"]) == (5, 6.5)


@pytest.mark.parametrize("costs, want", [([3.0], 3.0), ([1.0, 9.0], 1.0), ([1.0, 2.0, 3.0], 2.0), ([2.5, 2.0, 3.0], 2.5)])
def test_partial_newest_slot_is_skipped(spark, costs, want):
    rows = [charge(start=datetime(2024, 1, 20, 8 - i, tzinfo=UTC), cost=c, lag=0) for i, c in enumerate(costs)]
    seen = scan_billing_export(billing(spark, *rows), AS_OF)
    burn = B.estimate_burn_from_history(B.charge_history(B.last_n_charges(seen, AS_OF))).first()
    assert burn["slot_cost"] == want


def test_reconcile_and_fees(spark):
    hour = lambda h: datetime(2024, 1, 20, h, tzinfo=UTC)
    calc = spark.createDataFrame([("p", hour(10), "S", 5.0), ("p", hour(11), "S", 1.0), ("p", hour(11), "T", 2.0)],
                                 "project_id string, usage_hour timestamp, sku_id string, calc double")
    seen = billing(spark, charge(start=hour(10), cost=2.0), charge(start=hour(9), cost=4.0), charge(sku="U", start=hour(9), cost=1.0))
    cells = B.reconcile_charges(calc, B.last_n_charges(seen, AS_OF))
    got = {(r["usage_hour"].astimezone(UTC).hour, r["sku_id"]): (r["sku_description"], r["calc"], r["reported"]) for r in cells.collect()}
    assert got == {(10, "S"): ("Instance Core", 5.0, 2.0), (11, "S"): ("Instance Core", 1.0, 0.0),
                   (11, "T"): ("No description collected", 2.0, 0.0), (9, "S"): ("Instance Core", 0.0, 4.0),
                   (9, "U"): ("Instance Core", 0.0, 1.0)}
    fees = B.additional_fees(cells)
    assert fees.first()["additional_fees"] == pytest.approx(3 + 1 + 2)
    hourly = B.per_hour_charge(calc, AS_OF)
    assert hourly.first()["per_hour_charge"] == pytest.approx(3.0)

    alert = "project_id string, interval_start timestamp, cost double, budget double, event_time timestamp, message_id long"
    month = lambda m: datetime(2024, m, 1, tzinfo=UTC)
    alerts = spark.createDataFrame([
        ("p", month(1), 50.0, 90.0, hour(3), 3), ("p", month(1), 20.0, 80.0, hour(2), 2), ("p", month(2), 30.0, 100.0, hour(4), 4),
        ("idle", month(1), 10.0, 10.0, hour(1), 1), ("quiet", month(1), 10.0, 20.0, hour(1), 1)], alert)
    status = {r["project_id"]: r for r in B.budget_status(
        B.cumulative_spend(B.interval_costs(alerts)), fees, hourly).collect()}
    p = status["p"]
    assert (p["reported_spend"], p["budget"], p["total_spend"], p["over_budget"]) == (80.0, 100.0, 86.0, False)
    assert p["hours_left"] == pytest.approx(14 / 3)
    # exactly at the budget counts as over; nothing running leaves hours unknown
    assert (status["idle"]["over_budget"], status["idle"]["hours_left"]) == (True, None)
    assert (status["quiet"]["over_budget"], status["quiet"]["hours_left"]) == (False, None)


def test_weekly_throttle(spark):
    at = lambda s: datetime.fromisoformat(s).replace(tzinfo=UTC)
    rows = [("p", "2", at("2020-12-29 01:00:00")), ("p", "2", at("2021-01-02 01:00:00")),  # same ISO week over the year end
            ("p", "2", at("2021-01-05 01:00:00")), ("p", "1", at("2021-01-02 01:00:00")),
            ("p", "4", at("2021-01-02 01:00:00")), ("p", "4", at("2021-01-02 02:00:00")),
            ("p", "2", at("2015-12-29 01:00:00"))]  # week 53 of another year
    df = spark.createDataFrame(rows, "project_id string, alert string, event_time timestamp")
    got = K.weekly_throttle(df)
    assert sorted((r["alert"], r["iso_year"], r["iso_week"]) for r in got.collect()) == [
        ("1", 2020, 53), ("2", 2015, 53), ("2", 2020, 53), ("2", 2021, 1), ("4", 2020, 53), ("4", 2020, 53)]
    first = got.where("alert = '2' AND iso_year = 2020").first()["event_time"].astimezone(UTC)
    assert first == at("2020-12-29 01:00:00")
    assert {r["alert"] for r in K.weekly_throttle(df, fired=got).collect()} == {"4"}


def test_action_plan(spark):
    status = spark.createDataFrame([("a", True, 2.0), ("b", True, 1.2), ("c", False, 0.5), ("d", False, 0.5), ("e", True, 1.0)],
                                   "project_id string, over_budget boolean, fraction double")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "project_id string")
    apps = spark.createDataFrame([("a", True), ("b", False)], "project_id string, has_app boolean")
    got = {}
    for r in K.action_plan(status, ids("a", "b", "c"), apps, ids("a", "c"), 1.5).orderBy("step").collect():
        got.setdefault(r["project_id"], []).append(r["action"])
    assert got == {"a": ["STOP_ALL_VMS", "STOP_APP", "DETACH_BILLING"], "b": ["STOP_ALL_VMS"], "c": ["STOP_EXCESS"],
                   "d": ["NONE"], "e": ["NONE"]}


def test_old_budget_documents(spark):
    docs = spark.createDataFrame([
        ("old", '{"2024-01": 5.0, "2024-02": 7}'), ("middle", '{"messages": {}, "amounts": {"2024-01": 1.5}}'),
        ("new", '{"messages": {"1": "07"}, "amounts": {"2024-01": 2.5}, "budget": 100}')], "project_id string, doc string")
    got = {(r["project_id"], r["budget"], r["interval_start"], r["cost"]) for r in state.budget_amounts(docs).collect()}
    assert got == {("old", None, "2024-01", 5.0), ("old", None, "2024-02", 7.0), ("middle", None, "2024-01", 1.5),
                   ("new", 100.0, "2024-01", 2.5)}


def test_billing_partitions_are_pruned(spark, tmp_path):
    rows = [charge(start=datetime(2024, 1, d, 5, tzinfo=UTC)) for d in range(1, 21)]
    path = str(tmp_path / "billing")
    billing(spark, *rows).write.partitionBy("export_date").parquet(path)
    seen = scan_billing_export(spark, AS_OF, path=path)
    plan = seen.select("cost")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(export_date" in plan and "2024-01-18" in plan
    assert "ReadSchema: struct<cost:double,export_time:timestamp>" in plan
    assert sorted({r["export_date"].day for r in seen.collect()}) == [19, 20]


def test_every_slot_of_the_grid_is_reconciled(spark):
    """More slots than the ranking keeps, and one before the first hour of the estimate."""
    hour = lambda h, m=0: datetime(2024, 1, 20, h, m, tzinfo=UTC)
    last = AS_OF.hour
    starts = [hour(h, m) for h in range(last - 8, last) for m in (0, 30)]
    early = AS_OF.replace(tzinfo=UTC) - timedelta(hours=14)
    seen = billing(spark, *[charge(start=s, hours=0.5, cost=1.0) for s in [*starts, early]])
    calc = spark.createDataFrame([("p", hour(h), "S", 2.0) for h in range(last - 8, last)],
                                 "project_id string, usage_hour timestamp, sku_id string, calc double")
    cells = B.reconcile_charges(calc, B.recent_slots(seen, AS_OF))
    assert {(r["calc"], r["reported"]) for r in cells.collect()} == {(2.0, 2.0)}
    assert B.additional_fees(cells).first()["additional_fees"] == 0.0
    assert "SortAggregate" not in B.reconcile_charges(calc, B.recent_slots(seen, AS_OF))._jdf.queryExecution().executedPlan().toString()


def test_estimate_only_run_decides_nothing(spark, tmp_path):
    from dataclasses import replace

    from tallyforge.plans import budget
    from tallyforge.workload import adapters as A
    from tallyforge.workload.landing import current_vms
    from tallyforge.workload.q_lookup import inputs

    sf = "/root/testdata/sf0.001"
    i = replace(inputs(spark, sf), listed_vms=current_vms(spark, sf).where("vm_id like '%1'"))
    tables = budget.control_run(i, A.AS_OF, budget.Limits(), str(tmp_path), 1, estimate_only=True)
    assert set(tables) == {"estimated_costs", "reconciliation", "unpriced", "unusable_prices"}
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(tables)


def test_runs_of_the_controller(spark, tmp_path):
    """A second run of the week stays silent for throttled alerts; a repeated run does not change."""
    from tallyforge.plans import budget
    from tallyforge.workload import adapters as A
    from tallyforge.workload.q_lookup import inputs

    limits = budget.Limits(max_cpus=4, egress_multiplier=0.0001)

    i = inputs(spark, "/root/testdata/sf0.001")
    out = str(tmp_path)
    kinds = lambda t: sorted((r["project_id"], r["alert"]) for r in t["alerts"].collect())
    first = kinds(budget.control_run(i, A.AS_OF, limits, out, 1))
    again = kinds(budget.control_run(i, A.AS_OF, limits, out, 1))
    second = budget.control_run(i, A.AS_OF + timedelta(hours=1), limits, out, 2)
    assert first == again and {"1", "2"} & {a for _, a in first}
    assert kinds(second) == [x for x in first if x[1] in ("3", "4")]
    assert "proj-9" not in {r["project_id"] for r in second["estimated_costs"].select("project_id").distinct().collect()}
    assert second["cost_log"].count() >= second["budget_status"].count()
