"""Alerts, throttling and the stop plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge import constants as C
from tallyforge.functions.keys import iso_week, iso_year
from tallyforge.operators.inventory import is_running
from tallyforge.operators.projects import SPREADS


def _alert(rows: DataFrame, alert: str, value: str, threshold: Column) -> DataFrame:
    return rows.select("project_id", F.lit(alert).alias("alert"), F.col(value).cast("double").alias("value"),
                       threshold.cast("double").alias("threshold"))


def egress_alert(egress: DataFrame, budgets: DataFrame, multiplier: float) -> DataFrame:
    """Projects whose transfer charges exceed a share of their budget."""
    limit = F.lit(multiplier) * F.col("budget")
    rows = egress.join(budgets.select("project_id", "budget"), "project_id")
    return _alert(rows.where(F.col("total_egress") > limit), C.ALERT_EGRESS, "total_egress", limit)


def over_budget_alert(status: DataFrame) -> DataFrame:
    """Projects that used up their budget."""
    return _alert(status.where("over_budget"), C.ALERT_OVER_BUDGET, "fraction", F.lit(1.0))


def cpu_cap_alert(cpus: DataFrame, max_cpus: int) -> DataFrame:
    """Projects running too many CPUs, and how many too many."""
    over = cpus.where(F.col("total_cpus") > F.lit(max_cpus))
    return _alert(over, C.ALERT_CPU_CAP, "total_cpus", F.lit(max_cpus)).withColumn(
        "excess", F.col("value") - F.col("threshold"))


def pull_billing_alert(status: DataFrame, pull_multiplier: float) -> DataFrame:
    """Over-budget projects so far over that billing is to be detached."""
    far = status.where(F.col("over_budget") & (F.col("fraction") >= F.lit(pull_multiplier)))
    return _alert(far, C.ALERT_PULL_BILLING, "fraction", F.lit(pull_multiplier))


THROTTLED = (C.ALERT_EGRESS, C.ALERT_OVER_BUDGET)
WEEK_KEY = ["project_id", "alert", "iso_year", "iso_week"]


def with_iso_week(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("iso_year", iso_year("event_time")).withColumn("iso_week", iso_week("event_time"))


def weekly_throttle(alerts: DataFrame, fired: DataFrame | None = None) -> DataFrame:
    """Throttled kinds fire once per project and ISO week, the others every time.

    The first of a week is a minimum per key, so a project that alerts without
    pause is reduced before the shuffle. ``fired`` (the week keys) holds what
    earlier runs sent.
    """
    dated = with_iso_week(alerts)
    throttled = F.col("alert").isin(*THROTTLED)
    columns = dated.columns
    rest = [c for c in columns if c not in (*WEEK_KEY, "event_time")]
    first = dated.where(throttled).groupBy(*WEEK_KEY).agg(F.min(F.struct("event_time", *rest)).alias("_f"))
    first = first.select(*WEEK_KEY, "_f.event_time", *[F.col(f"_f.{c}").alias(c) for c in rest]).select(columns)
    if fired is not None:
        first = first.join(fired.select(*WEEK_KEY).distinct(), WEEK_KEY, "left_anti")
    return first.unionByName(dated.where(~throttled))


def _before(parent: list[str], order: list[Column], weight: str = "_w") -> Column:
    earlier = W.partitionBy(*parent).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(earlier), F.lit(0.0))


def shutdown_list(vms: DataFrame, stop_counts: DataFrame | None = None) -> DataFrame:
    """Running VMs to stop, newest start first, until the CPUs exceed the stop count.

    A VM is taken while the CPUs of those before it do not exceed the count, so
    the one that crosses it is included. Without counts all running VMs stop.
    ``stop_counts`` is (project_id, stop_count); other projects stop nothing.

    The running total is built top down, so that no task ever sorts a whole
    project: totals per hour of start, then per second, then per exact start
    and hash prefix of the VM id, then single VMs, each level inside one group
    of the level above and cut off beyond the count. VMs started at the same
    instant go in order of that hash, then id.
    """
    running = vms.where(is_running()).select("project_id", "zone", "vm_id", "name", "cpus", "started")
    if stop_counts is None:
        return running.withColumn("cpus_before", F.lit(None).cast("double"))

    project = ["project_id"]
    hour, second, tie = [*project, "_hour"], [*project, "_hour", "_second"], [*project, "_hour", "_second", "_at", "_hash"]
    rows = (running.withColumn("_second", F.unix_seconds("started"))
            .withColumn("_hour", F.floor(F.col("_second") / F.lit(3600)))
            .withColumn("_at", F.unix_micros("started"))
            .withColumn("_hash", F.substring(F.md5(F.col("vm_id").cast("binary")), 1, 3)))

    def totals(level: DataFrame, keys: list[str], weight: str) -> DataFrame:
        return level.groupBy(*keys).agg(F.sum(weight).alias("_w"))

    ties = totals(rows, tie, "cpus")
    seconds = totals(ties, second, "_w")
    hours = totals(seconds, hour, "_w")

    def cut(level: DataFrame, keys: list[str], parent: list[str], *order: Column) -> DataFrame:
        total = (F.col("_base") + _before(parent, list(order))).alias("_before")
        taken = level.select(*keys, "stop_count", total).where(F.col("_before") <= F.col("stop_count"))
        return taken.withColumnRenamed("_before", "_base")

    limits = stop_counts.select("project_id", F.col("stop_count").cast("double").alias("stop_count"),
                                F.lit(0.0).alias("_base"))
    open_hours = cut(hours.join(limits, project), hour, project, F.desc("_hour"))
    open_seconds = cut(seconds.join(open_hours, hour), second, hour, F.desc("_second"))
    open_ties = cut(ties.join(open_seconds, second), tie, second, F.desc("_at"), F.asc("_hash"))
    last = rows.join(open_ties, tie).withColumn(
        "cpus_before", F.col("_base") + _before(tie, [F.asc("vm_id")], "cpus"))
    return last.where(F.col("cpus_before") <= F.col("stop_count")).select(*running.columns, "cpus_before")


def join_place(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with facts of their project and zone, a large zone spread by name."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(SPREADS - 1)))
    return (rows.withColumn("_spread", F.pmod(F.xxhash64("name"), F.lit(SPREADS)).cast("int"))
            .join(facts.withColumn("_spread", spread), ["project_id", "zone", "_spread"]).drop("_spread"))


def stops_by_zone(stops: DataFrame, max_names: int = 1000) -> DataFrame:
    """One row per machine to stop: project_id, zone, name, chunk.

    ``chunk`` numbers requests of about ``max_names`` names within a zone; the
    rows are the same whatever the size of a zone.
    """
    place = ["project_id", "zone"]
    chunks = stops.groupBy(*place).agg(F.ceil(F.count("*") / F.lit(max_names)).cast("bigint").alias("chunks"))
    bucket = F.conv(F.substring(F.md5(F.col("name").cast("binary")), 1, 8), 16, 10).cast("bigint") % F.col("chunks")
    return join_place(stops.select(*place, "name"), chunks).select(*place, "name", bucket.alias("chunk"))


def action_plan(status: DataFrame, running: DataFrame, settings: DataFrame, excess: DataFrame,
                pull_multiplier: float) -> DataFrame:
    """What to do about each project, one row per action.

    ``running`` is ``running_cpus`` (a project in it has VMs to stop), ``settings``
    has has_app per project, ``excess`` the projects with excess VMs to stop.
    """
    facts = (
        status.select("project_id", "over_budget", "fraction")
        .join(running.select("project_id", F.lit(True).alias("_vms")), "project_id", "left")
        .join(settings.select("project_id", F.col("has_app").alias("_app")), "project_id", "left")
        .join(excess.select("project_id", F.lit(True).alias("_excess")).distinct(), "project_id", "left")
    )
    over, yes = F.col("over_budget"), F.lit(True)
    actions = F.array_compact(F.array(
        F.when(over & F.col("_vms").eqNullSafe(yes), "STOP_ALL_VMS"),
        F.when(over & F.col("_app").eqNullSafe(yes), "STOP_APP"),
        F.when(over & (F.col("fraction") >= F.lit(pull_multiplier)), "DETACH_BILLING"),
        F.when(~over & F.col("_excess").eqNullSafe(yes), "STOP_EXCESS"),
    ))
    named = F.when(F.size(actions) > 0, actions).otherwise(F.array(F.lit("NONE")))
    return facts.select("project_id", F.posexplode(named).alias("step", "action"))
