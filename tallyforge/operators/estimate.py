"""Cost estimates from inventory.

Priced rows come from ``vm_skus`` and ``disk_skus``; a cost is always
hours x rate x quantity, with the quantity chosen per component there.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge import constants as C
from tallyforge.functions.keys import hour_floor, hours_between, instant, minutes_between
from tallyforge.operators.inventory import overlap_minutes, usage_slots

_INTERVALS = ("uptime", "last_day", "hourly")


def _expected_unit() -> Column:
    units = F.create_map(*[F.lit(x) for pair in C.COMPONENT_UNITS.items() for x in pair])
    return units[F.col("component")]


def check_units(skus: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``unit_ok``; a machine without memory price is fine. ``strict`` fails instead."""
    no_ram = (F.col("component") == "ram") & F.col("unit").isNull()
    ok = no_ram | F.coalesce(F.col("unit") == _expected_unit(), F.lit(False))
    if strict:
        ok = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(
            F.lit("unexpected pricing units: "), F.coalesce("unit", F.lit("NULL")))).cast("boolean"))
    return skus.withColumn("unit_ok", ok)


def usable_prices(skus: DataFrame) -> DataFrame:
    """The rows in the unit their component is billed by; nothing else may be costed."""
    return check_units(skus).where("unit_ok").drop("unit_ok")


def unusable_prices(vm_skus: DataFrame, disk_skus: DataFrame) -> DataFrame:
    """What a cost run leaves out for its unit: one row per resource and component."""
    rows = [df.select("project_id", F.col(key).alias("resource_id"), "component", "sku_id", "unit")
            for df, key in ((vm_skus, "vm_id"), (disk_skus, "disk_id"))]
    return check_units(rows[0].unionByName(rows[1])).where("NOT unit_ok").drop("unit_ok")


def _rate() -> Column:
    return F.coalesce("rate", F.lit(0.0))


def _component_cost(skus: DataFrame, *components: str) -> DataFrame:
    rows = skus.where(F.col("component").isin(*components))
    return rows.select("project_id", "vm_id", "component", "sku_id",
                       (F.col("hours") * _rate() * F.col("quantity")).alias("cost"))


def core_ram_cost(skus: DataFrame) -> DataFrame:
    """Core and memory cost of ``hours``: cores are CPUs over CPUs per core."""
    return _component_cost(skus, "cpu", "ram")


def gpu_cost(skus: DataFrame) -> DataFrame:
    """Accelerator cost of ``hours``, one row per accelerator entry."""
    return _component_cost(skus, "gpu")


def license_cost(skus: DataFrame) -> DataFrame:
    """License cost of ``hours``; the CPU license is not multiplied by CPUs."""
    return _component_cost(skus, "cpu_lic", "gpu_lic", "ram_lic")


def disk_cost(skus: DataFrame) -> DataFrame:
    """Disk cost of ``hours``, with a month of 730 hours."""
    cost = _rate() * (F.col("hours") / F.lit(C.CONTROLLER_MONTH_HOURS)) * F.col("quantity")
    return skus.select("project_id", "disk_id", "sku_id", cost.alias("cost"))


def hourly_cost_per_sku(vm_skus: DataFrame, disk_skus: DataFrame, as_of: datetime,
                        include_stopped: bool = False) -> DataFrame:
    """Estimated cost per project, hour and SKU over the last 13 hours.

    ``vm_skus`` carries status, started and last_stop; ``disk_skus`` created.

    A run that is still going covers its first slot in part and every later slot
    in full. So runs are summed per (project, SKU, first slot) first, and only
    those sums are spread over the hours: the 13-fold explode happens after
    aggregation, and no shuffle sees it.
    """
    now = instant(as_of)
    vm_skus, disk_skus = usable_prices(vm_skus), usable_prices(disk_skus)
    running = F.col("status") == "RUNNING"
    vm_rate = (_rate() * F.col("quantity")).alias("hour_rate")
    disk_rate = (_rate() * F.col("quantity") / F.lit(C.CONTROLLER_MONTH_HOURS)).alias("hour_rate")
    vms = vm_skus.where(F.col("sku_id").isNotNull())
    open_runs = vms.where(running).select("project_id", "sku_id", F.col("started").alias("start"), vm_rate).unionByName(
        disk_skus.select("project_id", "sku_id", F.col("created").alias("start"), disk_rate))

    start = F.greatest(F.col("start"), F.element_at(usage_slots(as_of), 1))
    first = hour_floor("start")
    part = minutes_between("start", F.least(F.col("first") + F.expr("interval 1 hour"), now)) / F.lit(60.0)
    sums = (
        open_runs.where(F.col("start") < now)
        .select("project_id", "sku_id", start.alias("start"), "hour_rate")
        .select("project_id", "sku_id", first.alias("first"), "start", "hour_rate")
        .groupBy("project_id", "sku_id", "first")
        .agg(F.sum("hour_rate").alias("full"), F.sum(F.col("hour_rate") * part).alias("partial"))
    )
    later = minutes_between("usage_hour", F.least(F.col("usage_hour") + F.expr("interval 1 hour"), now)) / F.lit(60.0)
    spread = sums.select(
        "project_id", "sku_id", "first", "full", "partial",
        F.explode(F.sequence(F.col("first"), hour_floor(now), F.expr("interval 1 hour"))).alias("usage_hour"))
    cells = spread.select("project_id", "usage_hour", "sku_id", F.when(
        F.col("usage_hour") == F.col("first"), F.col("partial")).otherwise(F.col("full") * later).alias("cost"))

    if include_stopped:
        closed = vms.where(~running & F.col("last_stop").isNotNull()).select(
            "project_id", "sku_id", "started", F.least("last_stop", now).alias("stopped"), vm_rate)
        slots = closed.where(F.col("stopped") > F.element_at(usage_slots(as_of), 1)).select(
            "*", F.explode(usage_slots(as_of)).alias("usage_hour"))
        minutes = overlap_minutes(F.col("started"), F.col("stopped"), F.col("usage_hour"))
        cells = cells.unionByName(slots.select(
            "project_id", "usage_hour", "sku_id", (F.col("hour_rate") * minutes / F.lit(60.0)).alias("cost")))
    return (cells.groupBy("project_id", "usage_hour", "sku_id").agg(F.sum("cost").alias("calc"))
            .where("calc <> 0"))


def _interval_hours(start: str, as_of: datetime) -> Column:
    up = hours_between(start, instant(as_of))
    hours = {"uptime": up, "last_day": F.least(up, F.lit(24.0)), "hourly": F.lit(1.0)}
    return F.array(*[F.struct(F.lit(n).alias("interval"), hours[n].alias("hours")) for n in _INTERVALS])


def machine_cost_intervals(vm_skus: DataFrame, as_of: datetime) -> DataFrame:
    """Cost of each running VM since its start, in the last day and per hour.

    Here the core price stands for the whole machine: it is not multiplied by
    the CPU count, unlike in ``core_ram_cost``.
    """
    quantity = F.when(F.col("component") == "cpu", F.lit(1.0)).otherwise(F.col("quantity"))
    per_vm = (usable_prices(vm_skus).where(F.col("status") == "RUNNING")
              .groupBy("project_id", "vm_id", "started")
              .agg(F.sum(_rate() * quantity).alias("hour_rate")))
    spread = per_vm.select("project_id", "vm_id", "hour_rate", F.inline(_interval_hours("started", as_of)))
    return spread.select("project_id", "vm_id", "interval", "hours",
                         (F.col("hours") * F.col("hour_rate")).alias("cost"))


def disk_cost_intervals(disk_skus: DataFrame, as_of: datetime) -> DataFrame:
    """Cost of each disk over the same intervals, with months of 30 days."""
    spread = usable_prices(disk_skus).select("project_id", "disk_id", "rate", "quantity",
                              F.inline(_interval_hours("created", as_of)))
    months = F.col("hours") / F.lit(24.0) / F.lit(C.ESTIMATOR_MONTH_DAYS)
    return spread.select("project_id", "disk_id", "interval", "hours",
                         (months * _rate() * F.col("quantity")).alias("cost"))


def project_burn(vm_costs: DataFrame, disk_costs: DataFrame, vms: DataFrame) -> DataFrame:
    """VM, disk and total cost of each project for each interval, and how many of its VMs run, priced or not."""
    running = vms.where(F.col("status") == "RUNNING").select(
        "project_id", F.lit("running").alias("interval"), F.lit(0.0).alias("cost"), F.lit("vm").alias("kind"))
    rows = vm_costs.select("project_id", "interval", "cost", F.lit("vm").alias("kind")).unionByName(
        disk_costs.select("project_id", "interval", "cost", F.lit("disk").alias("kind"))).unionByName(running)

    def cell(kind: str, interval: str) -> Column:
        here = (F.col("kind") == kind) & (F.col("interval") == interval)
        return F.sum(F.when(here, F.col("cost")).otherwise(0.0)).alias(f"{kind}_{interval}")

    cells = [cell(k, i) for i in _INTERVALS for k in ("vm", "disk")]
    summed = rows.groupBy("project_id").agg(*cells, F.count_if(F.col("interval") == "running").alias("vm_count"))
    totals = [(F.col(f"vm_{i}") + F.col(f"disk_{i}")).alias(f"total_{i}") for i in _INTERVALS]
    return summed.select("*", *totals)


def is_spending(burn: DataFrame) -> DataFrame:
    """Projects with any cost at all; only these are reported."""
    return burn.where(reduce(Column.__add__, [F.col(f"total_{i}") for i in _INTERVALS]) > 0)


def burn_projection(burn: DataFrame, horizons: tuple[int, ...] = (6, 12, 24)) -> DataFrame:
    """Hourly cost carried forward over each horizon."""
    ahead = burn.select("project_id", "vm_count", "vm_hourly", "disk_hourly", "total_hourly",
                        F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_hours"))
    return ahead.select("project_id", "vm_count", "horizon_hours", *[
        (F.col("horizon_hours") * F.col(f"{k}_hourly")).alias(f"{k}_cost") for k in ("vm", "disk", "total")])


def burn_log(burn: DataFrame) -> DataFrame:
    """Status line with the hourly rates of each spending project."""
    return is_spending(burn).select("project_id", _rates("per hour", "hourly").alias("line"))


def _rates(title: str, interval: str) -> Column:
    return F.format_string(f"{title}: machines $%f, disks $%f, together $%f", *[F.col(f"{k}_{interval}") for k in ("vm", "disk", "total")])


def burn_report(burn: DataFrame, horizons: tuple[int, ...] = (6, 12, 24)) -> DataFrame:
    """Lines of each spending project: since start, last day, per hour, and one per horizon with its running VMs."""
    ahead = [F.format_string(f"next {h} hours with %d running machines: machines $%f, disks $%f, together $%f", F.col("vm_count"),
                             *[F.lit(h) * F.col(f"{k}_hourly") for k in ("vm", "disk", "total")]) for h in horizons]
    lines = F.array(_rates("since start", "uptime"), _rates("last day", "last_day"), _rates("per hour", "hourly"), *ahead)
    return is_spending(burn).select("project_id", F.posexplode(lines).alias("line_no", "line"))
