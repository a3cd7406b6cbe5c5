"""Inventory state and time series.

Snapshots are rows (project, machine, inventory time). State is always reached
by aggregates that combine (latest row per machine, summary per run cycle), so
each shuffle carries one row per key and map task, however often a machine was
polled, and a stream can keep the same summaries.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge import constants as C
from tallyforge.functions.keys import (
    hour_floor, hours_between, instant, machine_class, minutes_between, month_floor, seconds_between)
from tallyforge.operators.projects import join_project

_VM = ["project_id", "vm_id"]
_CYCLE = [*_VM, "started"]


def is_running() -> Column:
    return F.col("status") == "RUNNING"


def split_by_status(vms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Running and stopped inventory."""
    return vms.where(is_running()), vms.where(~is_running())


def running_cpus(vms: DataFrame) -> DataFrame:
    """CPUs of running VMs per project."""
    return vms.where(is_running()).groupBy("project_id").agg(F.sum("cpus").alias("total_cpus"))


def latest(snapshots: DataFrame, keys: list[str], when: str = "inventory_time") -> DataFrame:
    """Newest row per key."""
    rest = [c for c in snapshots.columns if c not in (*keys, when)]
    newest = snapshots.groupBy(*keys).agg(
        F.max(when).alias("_when"), F.max_by(F.struct(*rest), when).alias("_row"))
    return newest.select(*keys, F.col("_when").alias(when), *[F.col(f"_row.{c}").alias(c) for c in rest]).select(
        snapshots.columns)


def latest_vms(snapshots: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Inventory as known at ``as_of``."""
    seen = snapshots if as_of is None else snapshots.where(F.col("inventory_time") <= instant(as_of))
    return latest(seen, _VM)


def upsert_vms(state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Known VMs refreshed by the snapshot, unseen ones added."""
    return latest(state.unionByName(snapshot), _VM)


def upsert_disks(state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Known disks refreshed by the snapshot, unseen ones added."""
    return latest(state.unionByName(snapshot), ["project_id", "disk_id"])


def _prune(state: DataFrame, current: DataFrame, enabled: DataFrame | None, keys: list[str]) -> DataFrame:
    listed = current.select(*keys).distinct()
    if enabled is None:
        return state.join(listed, keys, "left_semi")
    on = enabled.select("project_id").distinct().withColumn("_on", F.lit(True))
    marked = join_project(state.join(listed.withColumn("_listed", F.lit(True)), keys, "left"), on, "left", keys[-1])
    return marked.where(F.col("_listed").isNotNull() | F.col("_on").isNull()).select(state.columns)


def prune_vms(state: DataFrame, current: DataFrame, enabled: DataFrame | None = None) -> DataFrame:
    """VMs still listed, running or stopped.

    With ``enabled`` (project_id), projects outside it list nothing and keep
    their state.
    """
    return _prune(state, current, enabled, _VM)


def prune_disks(state: DataFrame, current: DataFrame, enabled: DataFrame | None = None) -> DataFrame:
    """Disks still listed, by the same rule."""
    return _prune(state, current, enabled, ["project_id", "disk_id"])


# --- run cycles ---------------------------------------------------------------

def vm_cycles(snapshots: DataFrame) -> DataFrame:
    """What the snapshots say about each run cycle, one row per (VM, started).

    Every column is a minimum or maximum by inventory time, so summaries of
    parts, in any order, merge into the summary of the whole.
    """
    at, stopped = F.col("inventory_time"), ~is_running()
    return snapshots.groupBy(*_CYCLE).agg(
        F.min(at).alias("first_seen"),
        F.max(at).alias("last_seen"),
        F.min(F.when(stopped, at)).alias("first_stopped"),
        F.min_by(F.col("last_stop"), F.when(stopped, at)).alias("stop_reported"),
        F.min_by(is_running(), at).alias("opens_running"),
        F.min_by(F.col("last_stop"), at).alias("opens_last_stop"),
    )


def merge_cycles(parts: DataFrame) -> DataFrame:
    """Summaries of several snapshot sets to one."""
    return parts.groupBy(*_CYCLE).agg(
        F.min_by("opens_running", "first_seen").alias("opens_running"),
        F.min_by("opens_last_stop", "first_seen").alias("opens_last_stop"),
        F.min_by("stop_reported", "first_stopped").alias("stop_reported"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min("first_stopped").alias("first_stopped"),
    ).select(parts.columns)


def cycle_intervals(cycles: DataFrame) -> DataFrame:
    """Start and stop of every cycle; the running one has stop NULL.

    Seen stopped: the stop reported first. Else replaced by a running cycle:
    the stop that one reports. Else replaced by a stopped cycle: the last time
    this one was seen, the cautious choice.
    """
    by_time = W.partitionBy(*_VM).orderBy("first_seen", "started")
    after = lambda c: F.lead(c).over(by_time)
    rows = cycles.select(
        *_CYCLE, "last_seen", "first_stopped", "stop_reported",
        after("opens_running").alias("_next_running"), after("opens_last_stop").alias("_next_stop"))
    stop = (F.when(F.col("first_stopped").isNotNull(), F.col("stop_reported"))
            .when(F.col("_next_running"), F.col("_next_stop"))
            .when(~F.col("_next_running"), F.col("last_seen")))
    return rows.select(*_VM, F.col("started").alias("start"), stop.alias("stop"))


def uptime_intervals(snapshots: DataFrame) -> DataFrame:
    """Run/stop history of every VM."""
    return cycle_intervals(vm_cycles(snapshots))


def uptime_this_month(intervals: DataFrame, as_of: datetime) -> DataFrame:
    """Minutes since month start that each running VM was up, whole seconds."""
    now = instant(as_of)
    month = month_floor(now)
    stop = F.coalesce("stop", now)
    micros = F.unix_micros(stop) - F.unix_micros(F.greatest("start", month))
    total = F.coalesce(F.sum(F.when(stop >= month, micros)), F.lit(0))
    return (
        intervals.groupBy(*_VM)
        .agg((F.floor(total / F.lit(1000000)) / F.lit(60.0)).alias("uptime_minutes"),
             F.max(F.col("stop").isNull()).alias("_running"))
        .where("_running").drop("_running")
    )


def machine_uptime_hours(vms: DataFrame, as_of: datetime) -> DataFrame:
    """Hours since each running VM was last started."""
    return vms.where(is_running()).select(
        *_VM, hours_between("started", instant(as_of)).alias("uptime_hours"))


def sustained_use_tiers(spark: SparkSession) -> DataFrame:
    """The published tiers: machine_class, min_minutes, multiplier."""
    return spark.createDataFrame([(c, float(m), x) for c, m, x in C.SUSTAINED_USE_TIERS],
                                 "machine_class string, min_minutes double, multiplier double")


def discount_bands(tiers: DataFrame) -> DataFrame:
    """Tiers as bands (above, up_to] that do not overlap, so that an uptime is in one of its class at most.

    Of tiers with the same bound the smallest multiplier counts.
    """
    bounds = tiers.groupBy("machine_class", "min_minutes").agg(F.min("multiplier").alias("multiplier"))
    following = F.lead("min_minutes").over(W.partitionBy("machine_class").orderBy("min_minutes"))
    return bounds.select("machine_class", F.col("min_minutes").alias("above"), following.alias("up_to"), "multiplier")


def sustained_discount(uptime: DataFrame, vms: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """Discount multiplier of each VM with an uptime; exposed, applied to no cost.

    The tier whose bound is strictly exceeded, the highest if several; 1.0
    outside the tiers. ``tiers`` is a table like ``sustained_use_tiers``; its
    bands join on the class and the range, broadcast while Spark finds them small.
    """
    bands = discount_bands(sustained_use_tiers(uptime.sparkSession) if tiers is None else tiers)
    rows = uptime.join(vms.select(*_VM, "machine_type"), _VM).withColumn("_class", machine_class("machine_type"))
    minutes = F.col("uptime_minutes")
    inside = ((F.col("_class") == F.col("machine_class")) & (minutes > F.col("above"))
              & (F.col("up_to").isNull() | (minutes <= F.col("up_to"))))
    return rows.join(bands, inside, "left").select(
        *_VM, "machine_type", "uptime_minutes", F.coalesce("multiplier", F.lit(1.0)).alias("multiplier"))


# --- hourly slots --------------------------------------------------------------

def usage_slots(as_of: datetime | Column) -> Column:
    """Array of the 13 hours ending with the current one."""
    hour = hour_floor(instant(as_of))
    back = F.expr(f"interval {C.USAGE_SLOTS - 1} hours")
    return F.sequence(hour - back, hour, F.expr("interval 1 hour"))


def overlap_minutes(start: Column, stop: Column, slot: Column) -> Column:
    """Minutes of [start, stop] inside the hour beginning at ``slot``."""
    slot_end = slot + F.expr("interval 1 hour")
    return F.greatest(minutes_between(F.greatest(start, slot), F.least(stop, slot_end)), F.lit(0.0))


def usage_hours(runs: DataFrame, as_of: datetime, keys: tuple[str, ...] = ("project_id", "vm_id"),
                start: str = "started", stop: str | None = None) -> DataFrame:
    """Minutes each resource ran in each of the last 13 hours; hours without use are absent.

    ``stop`` names a column of end times, NULL while still running. Several runs
    of one resource may share an hour; their minutes add up.
    """
    now = instant(as_of)
    end = now if stop is None else F.least(F.coalesce(stop, now), now)
    slots = runs.select(*keys, F.col(start).alias("_start"), end.alias("_end"),
                        F.explode(usage_slots(as_of)).alias("usage_hour"))
    minutes = overlap_minutes(F.col("_start"), F.col("_end"), F.col("usage_hour"))
    used = slots.select(*keys, "usage_hour", minutes.alias("minutes")).where("minutes > 0")
    if stop is None:
        return used
    return used.groupBy(*keys, "usage_hour").agg(F.sum("minutes").alias("minutes"))


def retain_13_hours(series: DataFrame, as_of: datetime, hour: str = "usage_hour") -> DataFrame:
    """Drop slots older than the 13 kept; works on batch and streaming series."""
    hours = F.expr(f"interval {C.USAGE_SLOTS - 1} hours")
    return series.where(F.col(hour) >= hour_floor(instant(as_of)) - hours)


def inventory_gap(snapshots: DataFrame) -> DataFrame:
    """Whole seconds between each inventory of a project and the one before.

    A project's times are compared inside each hour, and the last time of the
    hour before is carried in from a summary of one row per hour, so a project
    with very many inventories is still spread over its hours.
    """
    hour = hour_floor("inventory_time").alias("_hour")
    times = snapshots.select("project_id", hour, "inventory_time").distinct()
    ends = times.groupBy("project_id", "_hour").agg(F.max("inventory_time").alias("_last"))
    carried = ends.select("project_id", "_hour", F.lag("_last").over(
        W.partitionBy("project_id").orderBy("_hour")).alias("_carried"))
    inside = F.lag("inventory_time").over(W.partitionBy("project_id", "_hour").orderBy("inventory_time"))
    rows = times.join(carried, ["project_id", "_hour"]).select(
        "project_id", "inventory_time", F.coalesce(inside, "_carried").alias("previous"))
    return rows.select("project_id", "inventory_time",
                       seconds_between("previous", "inventory_time").alias("gap_seconds"))
