"""Inventory state against plain Python re-statements of the rules."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions import keys as KEYS
from tallyforge.operators import control as K
from tallyforge.operators import estimate as E
from tallyforge.operators import inventory as I
from tallyforge.sources import inventory as SRC
from tallyforge.sources import mappings

UTC = timezone.utc
AS_OF = datetime(2024, 1, 20, 12, 34, 56)
T0 = datetime(2024, 1, 1, tzinfo=UTC)
SNAP = "project_id string, vm_id string, inventory_time timestamp, status string, started timestamp, last_stop timestamp"


def history(rng: random.Random, vm: str, every: int):
    """A VM's true cycles, and what polls at random times saw of them."""
    cycles, t, last_stop = [], T0 + timedelta(minutes=rng.randrange(600)), None
    while t < T0 + timedelta(days=6):
        stop = t + timedelta(minutes=rng.randrange(5, 900))
        cycles.append((t, stop))
        t = stop + timedelta(minutes=rng.randrange(5, 900))
    rows = []
    poll = cycles[0][0] + timedelta(minutes=1)
    while poll < T0 + timedelta(days=6):
        k = max(i for i, c in enumerate(cycles) if c[0] <= poll)
        start, stop = cycles[k]
        if poll < stop:
            rows.append(("p", vm, poll, "RUNNING", start, cycles[k - 1][1] if k else None))
        else:
            rows.append(("p", vm, poll, "TERMINATED", start, stop))
        poll += timedelta(minutes=rng.randrange(10, every))
    return rows


def replay(rows):
    """The rules as a state machine over one VM's snapshots, the missed cycle recorded at once."""
    closed, opened, seen = {}, None, None
    for _, _, at, status, started, last_stop in rows:
        if status == "RUNNING":
            if opened is not None and opened != started:
                closed[opened] = last_stop
            if opened != started and started not in closed:
                opened = started
        else:
            if opened is not None and opened != started:
                closed[opened] = seen
            if started not in closed:
                closed[started] = last_stop
            opened = None
        seen = at
    out = set(closed.items())
    if opened is not None:
        out.add((opened, None))
    return out


@pytest.mark.parametrize("every", [60, 700, 3000])
def test_uptime_intervals_equal_the_state_machine(spark, every):
    rng = random.Random(every)
    per_vm = {f"vm{i}": history(rng, f"vm{i}", every) for i in range(25)}
    rows = [r for v in per_vm.values() for r in v]
    rng.shuffle(rows)
    expected = {(vm, a, b) for vm, v in per_vm.items() for a, b in replay(v)}
    utc = lambda t: t and t.astimezone(UTC)
    intervals = I.uptime_intervals(spark.createDataFrame(rows, SNAP)).collect()
    assert {(r["vm_id"], utc(r["start"]), utc(r["stop"])) for r in intervals} == expected


def test_cycles_merge_in_any_split(spark):
    rng = random.Random(7)
    rows = [r for i in range(20) for r in history(rng, f"vm{i}", 400)]
    whole = I.uptime_intervals(spark.createDataFrame(rows, SNAP))
    rng.shuffle(rows)
    cut = len(rows) // 3
    parts = I.vm_cycles(spark.createDataFrame(rows[:cut], SNAP)).unionByName(
        I.vm_cycles(spark.createDataFrame(rows[cut:], SNAP)))
    again = I.cycle_intervals(I.merge_cycles(parts))
    assert whole.exceptAll(again).count() == 0 and again.exceptAll(whole).count() == 0


def test_uptime_this_month(spark):
    ts = lambda s: datetime.fromisoformat(s).replace(tzinfo=UTC)
    df = spark.createDataFrame([
        ("p", "never stopped", ts("2023-12-20 00:00:00"), None),
        ("p", "restarted", ts("2023-12-30 00:00:00"), ts("2024-01-02 00:00:00")),
        ("p", "restarted", ts("2024-01-20 12:04:56"), None),
        ("p", "long ago", ts("2023-12-01 00:00:00"), ts("2023-12-02 00:00:00")),
        ("p", "long ago", ts("2024-01-20 12:34:26"), None),
        ("p", "stopped", ts("2024-01-02 00:00:00"), ts("2024-01-03 00:00:00")),
    ], "project_id string, vm_id string, start timestamp, stop timestamp")
    got = {r["vm_id"]: r["uptime_minutes"] for r in I.uptime_this_month(df, AS_OF).collect()}
    assert got == {"never stopped": pytest.approx((19 * 24 + 12) * 60 + 34 + 56 / 60),
                   "restarted": pytest.approx(24 * 60 + 30), "long ago": pytest.approx(0.5)}


def test_discount_tiers_are_strict(spark):
    cases = [("n1-standard-4", 0.0, 1.0), ("n1-standard-4", 10950.0, 1.0), ("n1-standard-4", 10950.1, 0.8),
             ("n1-standard-4", 40000.0, 0.4), ("n2-standard-4", 22000.0, 0.733), ("e2-micro", 40000.0, 1.0),
             ("n2d-standard-2", 40000.0, 1.0)]
    rows = [("p", f"vm{i}", *c) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "project_id string, vm_id string, machine_type string, uptime_minutes double, want double")
    uptime, vms = df.select("project_id", "vm_id", "uptime_minutes"), df.select("project_id", "vm_id", "machine_type")
    found = I.sustained_discount(uptime, vms).join(df.select("vm_id", "want"), "vm_id")
    assert found.count() == len(cases) and found.where("multiplier != want").count() == 0
    # tiers are rows: others give other results, also where they are no longer small
    tiers = spark.createDataFrame([("e2", 100.0, 0.5), ("e2", 100.0, 0.4), ("e2", 50000.0, 0.1), ("n1", 0.0, 0.9)],
                                  "machine_class string, min_minutes double, multiplier double")
    for threshold in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            other = I.sustained_discount(uptime, vms, tiers)
            plan = other._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
            assert {r["vm_id"]: r["multiplier"] for r in other.collect()} == {
                "vm0": 1.0, "vm1": 0.9, "vm2": 0.9, "vm3": 0.9, "vm4": 1.0, "vm5": 0.4, "vm6": 1.0}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-3000, 2000), min_size=1, max_size=30))
def test_usage_hours_bounds_and_totals(spark, offsets):
    """Minutes are the run's overlap with the 13 hours, never above 60 each."""
    now = AS_OF.replace(tzinfo=UTC)
    rows = [("p", str(i), now + timedelta(minutes=m)) for i, m in enumerate(offsets)]
    df = I.usage_hours(spark.createDataFrame(rows, "project_id string, vm_id string, started timestamp"), AS_OF)
    got = {}
    for r in df.collect():
        assert 0 < r["minutes"] <= 60
        got[r["vm_id"]] = got.get(r["vm_id"], 0) + r["minutes"]
    window = datetime(2024, 1, 20, 0, tzinfo=UTC)
    for _, vm, start in rows:
        want = max((now - max(start, window)).total_seconds() / 60, 0)
        assert got.get(vm, 0) == pytest.approx(want)


def test_usage_of_several_runs_adds_up(spark):
    ts = lambda s: datetime.fromisoformat(s).replace(tzinfo=UTC)
    df = spark.createDataFrame([
        ("p", "v", ts("2024-01-20 10:00:00"), ts("2024-01-20 10:10:00")),
        ("p", "v", ts("2024-01-20 10:50:00"), None)],
        "project_id string, vm_id string, started timestamp, stop timestamp")
    rows = {r["usage_hour"].hour: r["minutes"] for r in I.usage_hours(df, AS_OF, stop="stop").collect()}
    assert rows == {10: pytest.approx(20), 11: pytest.approx(60), 12: pytest.approx(34 + 56 / 60)}


def test_hourly_cost_equals_plain_sum_over_slots(spark):
    rng = random.Random(3)
    now = AS_OF.replace(tzinfo=UTC)
    rows = []
    for i in range(200):
        start = now - timedelta(seconds=rng.randrange(60, 60 * 60 * 40))
        stopped = rng.random() < 0.3
        rows.append(("p%d" % (i % 3), f"v{i}", "TERMINATED" if stopped else "RUNNING", start,
                     start + (now - start) / 2 if stopped else None, f"S{i % 4}" if i % 9 else None, 0.5 + i % 5, 2.0))
    skus = spark.createDataFrame(rows, "project_id string, vm_id string, status string, started timestamp, "
                                       "last_stop timestamp, sku_id string, rate double, quantity double")
    skus = skus.withColumn("component", F.lit("cpu")).withColumn("unit", F.when(F.col("rate") < 4, "HOUR").otherwise("COUNT"))
    disks = spark.createDataFrame([("p0", "d", now - timedelta(hours=2), "D", 7.3, 100.0)],
                                  "project_id string, disk_id string, created timestamp, sku_id string, rate double, quantity double")
    disks = disks.withColumn("component", F.lit("disk")).withColumn("unit", F.lit("GIBIBYTE_MONTH"))
    for include in (False, True):
        want = {}
        for p, _, status, a, b, sku, rate, q in rows + [("p0", "d", "RUNNING", now - timedelta(hours=2), None, "D", 7.3 / 730, 100.0)]:
            # rates from 4 up are in another unit and must not be costed
            if sku is None or (4 <= rate and sku != "D") or (b is not None and not include):
                continue
            for h in range(13):
                slot = datetime(2024, 1, 20, h, tzinfo=UTC)
                secs = (min(b or now, slot + timedelta(hours=1)) - max(a, slot)).total_seconds()
                if secs > 0:
                    want[p, h, sku] = want.get((p, h, sku), 0) + secs / 3600 * rate * q
        got = {(r["project_id"], r["usage_hour"].hour, r["sku_id"]): r["calc"]
               for r in E.hourly_cost_per_sku(skus, disks, AS_OF, include).collect()}
        assert got == pytest.approx(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_shutdown_list_is_the_newest_prefix(spark, seed):
    rng = random.Random(seed)
    starts = [datetime(2024, 1, rng.randrange(1, 4), rng.randrange(24), rng.randrange(2), rng.randrange(3),
                       rng.randrange(3), tzinfo=UTC) for _ in range(8)]
    rows = [(f"p{i % 3}", "z", f"vm{i}", f"n{i}", float(rng.choice([1, 2, 8])), rng.choice(starts),
             "RUNNING" if rng.random() < 0.9 else "TERMINATED") for i in range(300)]
    vms = spark.createDataFrame(rows, "project_id string, zone string, vm_id string, name string, cpus double, "
                                      "started timestamp, status string")
    counts = {"p0": 5.0, "p1": 120.0}
    stop = spark.createDataFrame(list(counts.items()), "project_id string, stop_count double")
    got = K.shutdown_list(vms, stop).collect()
    for p, limit in counts.items():
        mine = {r["vm_id"] for r in got if r["project_id"] == p}
        running = [r for r in rows if r[0] == p and r[6] == "RUNNING"]
        stopped = [r for r in running if r[2] in mine]
        left = [r for r in running if r[2] not in mine]
        total = sum(r[4] for r in stopped)
        assert total > limit or not left
        # minimal: without one of its oldest machines the list would not exceed the count
        oldest = min(r[5] for r in stopped)
        assert min(total - r[4] for r in stopped if r[5] == oldest) <= limit
        assert all(r[5] <= oldest for r in left)
    assert not [r for r in got if r["project_id"] == "p2"]
    assert K.shutdown_list(vms).count() == sum(r[6] == "RUNNING" for r in rows)


def test_stops_by_zone_loses_nothing(spark):
    rows = [("p", f"z{i % 2}", f"n{i}") for i in range(101)]
    df = spark.createDataFrame(rows, "project_id string, zone string, name string")
    one = K.stops_by_zone(df).collect()
    assert sorted((r["zone"], r["name"], r["chunk"]) for r in one) == sorted((z, n, 0) for _, z, n in rows)
    many = K.stops_by_zone(df, max_names=5).collect()
    assert sorted(r["name"] for r in many) == sorted(r[2] for r in rows) and len({(r["zone"], r["chunk"]) for r in many}) > 10


def test_prune_reads_the_state_once_and_spreads_a_large_project(spark, tmp_path):
    rows = [("big" if i % 2 else f"p{i % 7}", f"v{i}", i) for i in range(400)]
    spark.createDataFrame(rows, "project_id string, vm_id string, x int").write.parquet(str(tmp_path / "state"))
    spark.createDataFrame([r[:2] for r in rows if r[2] % 3], "project_id string, vm_id string").write.parquet(str(tmp_path / "listed"))
    state, listed = (spark.read.parquet(str(tmp_path / n)) for n in ("state", "listed"))
    enabled = spark.createDataFrame([("big",), ("p2",), ("big",)], "project_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = I.prune_vms(state, listed, enabled)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["vm_id"] for r in got.collect()) == sorted(v for p, v, i in rows if i % 3 or p not in ("big", "p2"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("FileScan parquet") == 2
    assert "hashpartitioning(project_id#" in plan and not any(
        line.split("hashpartitioning(")[1].count(",") == 1 for line in plan.splitlines() if "hashpartitioning(project_id" in line)


def test_inventory_gap_across_hours_and_days(spark):
    rng = random.Random(5)
    times = sorted({T0 + timedelta(seconds=rng.randrange(86400 * 3)) for _ in range(200)})
    rows = [("p", f"v{j}", t) for t in times for j in range(2)]
    df = I.inventory_gap(spark.createDataFrame(rows, "project_id string, vm_id string, inventory_time timestamp"))
    got = {r["inventory_time"].astimezone(UTC): r["gap_seconds"] for r in df.collect()}
    want = {t: None if i == 0 else int((t - times[i - 1]).total_seconds()) for i, t in enumerate(times)}
    assert got == want


def test_prune_keeps_disabled_projects(spark):
    v = "project_id string, vm_id string"
    state = spark.createDataFrame([("on", "a"), ("on", "b"), ("off", "c")], v)
    listed = spark.createDataFrame([("on", "a"), ("on", "a")], v)
    enabled = spark.createDataFrame([("on",)], "project_id string")
    assert {tuple(r) for r in I.prune_vms(state, listed, enabled).collect()} == {("on", "a"), ("off", "c")}
    assert {tuple(r) for r in I.prune_vms(state, listed).collect()} == {("on", "a")}


def test_flatten_skips_empty_pages_and_missing_parts(spark):
    page = """{"items": {
      "zones/us-east1-b": {"instances": [
        {"id": "1", "name": "a", "status": "RUNNING", "creationTimestamp": "2021-06-01T10:20:30.123-07:00",
         "lastStartTimestamp": "2021-06-02T10:20:30.123-07:00", "machineType": "https://x/machineTypes/n1-standard-4",
         "disks": [{"diskSizeGb": "10", "kind": "k", "licenses": ["https://x/licenses/debian-9-stretch", "other"]}],
         "scheduling": {"preemptible": false},
         "guestAccelerators": [{"acceleratorType": "https://x/zones/us-east1-b/acceleratorTypes/nvidia-tesla-t4",
                                "acceleratorCount": 2}]},
        {"id": "2", "name": "b", "status": "TERMINATED", "creationTimestamp": "2021-06-01T10:20:30.123-0700",
         "lastStartTimestamp": "2021-06-01T10:20:30.123-07:00", "lastStopTimestamp": "2021-06-01T11:20:30.123-07:00",
         "machineType": "f1-micro", "disks": [{"diskSizeGb": "10", "kind": "k"}], "scheduling": {"preemptible": true}}]},
      "zones/empty": {"warning": {"code": "NO_RESULTS_ON_PAGE"}}}}"""
    df = spark.createDataFrame([("p", page)], "project_id string, raw_json string")
    a, b = sorted(SRC.flatten_vm_inventory(df).collect(), key=lambda r: r["vm_id"])
    assert (a["zone"], a["machine_type"], a["license"], a["last_stop"]) == ("us-east1-b", "n1-standard-4", "debian-9-stretch", None)
    assert [x.asDict() for x in a["accel"]] == [{"count": 2, "zone": "us-east1-b", "type": "nvidia-tesla-t4"}]
    assert a["created"].astimezone(UTC) == datetime(2021, 6, 1, 17, 20, 30, 123000, tzinfo=UTC)
    assert (b["license"], b["accel"], b["num_gpu"], b["created"]) == (None, [], 0, a["created"])


def test_load_mapping_checks_required(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("n1,Core,1,Ram\nf1-micro,Micro,1,\n")
    bad.write_text("n1,,1,Ram\n")
    rows = mappings.load_mapping(spark, str(good), schemas.CPU_MAPPING).collect()
    assert [tuple(r) for r in rows] == [("n1", "Core", 1, "Ram"), ("f1-micro", "Micro", 1, None)]
    with pytest.raises(PySparkException, match="REQUIRED column cpu"):
        mappings.load_mapping(spark, str(bad), schemas.CPU_MAPPING).collect()
    declared = mappings.declared_schema([{"name": "a", "type": "string", "mode": "REQUIRED"}, {"name": "b", "type": "INT64"}])
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in declared] == [("a", "string", False), ("b", "bigint", True)]


def test_scalar_keys(spark):
    row = spark.sql("SELECT 'n1-standard-4' AS t, 'us-east1-b' AS z, 'x' AS odd, 'a/b/c' AS url").select(
        KEYS.machine_key("t"), KEYS.machine_class("t"), KEYS.region_of_zone("z"), KEYS.region_of_zone("odd"),
        KEYS.last_path_segment("url"), KEYS.special_class("t")).first()
    assert tuple(row) == ("n1-standard", "n1", "us-east1", "", "c", None)
    week = spark.sql("SELECT TIMESTAMP '2021-01-03 00:00:00' AS t").select(KEYS.iso_year("t"), KEYS.iso_week("t")).first()
    assert tuple(week) == (2020, 53)


def test_burn_counts_running_machines_priced_or_not(spark):
    vm = spark.createDataFrame([("p", "v1", "RUNNING"), ("p", "v2", "RUNNING"), ("p", "v3", "TERMINATED"), ("q", "v4", "RUNNING")],
                               "project_id string, vm_id string, status string")
    cost = "project_id string, {} string, interval string, hours double, cost double"
    vms = spark.createDataFrame([("p", "v1", i, 1.0, 2.0) for i in ("uptime", "last_day", "hourly")], cost.format("vm_id"))
    burn = E.project_burn(vms, spark.createDataFrame([], cost.format("disk_id")), vm)
    got = {r["project_id"]: (r["vm_count"], r["total_hourly"]) for r in burn.collect()}
    assert got == {"p": (2, 2.0), "q": (1, 0.0)}
    lines = [r["line"] for r in E.burn_report(burn).orderBy("project_id", "line_no").collect()]
    assert len(lines) == 6 and lines[3].startswith("next 6 hours with 2 running machines: machines $12.0")


def test_unusable_prices_names_what_is_left_out(spark):
    columns = "project_id string, {} string, component string, sku_id string, unit string"
    vms = spark.createDataFrame([("p", "v", "cpu", "S", "COUNT"), ("p", "v", "ram", None, None), ("p", "w", "gpu", "G", "HOUR")], columns.format("vm_id"))
    disks = spark.createDataFrame([("p", "d", "disk", "D", "HOUR")], columns.format("disk_id"))
    assert {(r["resource_id"], r["component"]) for r in E.unusable_prices(vms, disks).collect()} == {("v", "cpu"), ("d", "disk")}
