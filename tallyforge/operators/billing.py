"""Analytics over reported charges."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge import constants as C
from tallyforge.functions.keys import hour_floor, instant, money, seconds_between

_SKU = ["project_id", "sku_id"]


def _is_transfer() -> Column:
    text = F.col("sku.description")
    return text.contains("ownload") | text.contains("gress")


def egress_costs(billing: DataFrame, ordered: bool = True) -> DataFrame:
    """Transfer charges per project, service, SKU, unit and invoice month, dearest first."""
    rows = billing.where(_is_transfer()).select(
        F.col("project.id").alias("project_id"),
        F.col("project.name").alias("project_name"),
        F.col("service.description").alias("service"),
        F.col("sku.description").alias("sku"),
        money("cost").alias("cost"),
        money("usage.amount").alias("usage_amount"),
        F.col("usage.unit").alias("usage_unit"),
        F.col("invoice.month").alias("invoice_yyyymm"),
    )
    keys = ["project_id", "project_name", "service", "sku", "usage_unit", "invoice_yyyymm"]
    sums = rows.groupBy(*keys).agg(
        F.sum("cost").cast("double").alias("total_cost"),
        F.sum("usage_amount").cast("double").alias("total_usage"))
    return sums.orderBy(F.desc("total_cost"), *keys) if ordered else sums


def egress_total(billing: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Transfer charges per project; 0.0 for listed projects without any."""
    sums = billing.where(_is_transfer()).groupBy(F.col("project.id").alias("project_id")).agg(
        F.sum(money("cost")).cast("double").alias("total_egress"))
    if projects is None:
        return sums
    return projects.select("project_id").distinct().join(sums, "project_id", "left").select(
        "project_id", F.coalesce("total_egress", F.lit(0.0)).alias("total_egress"))


def charge_slots(billing: DataFrame, min_charge: float = C.MIN_CHARGE) -> DataFrame:
    """Charges above the minimum, summed per SKU and usage slot."""
    rows = billing.where(F.col("cost") > F.lit(min_charge)).select(
        F.col("project.id").alias("project_id"), F.col("service.description").alias("description"),
        F.col("sku.id").alias("sku_id"), F.col("sku.description").alias("sku_description"),
        "usage_start_time", "usage_end_time", "export_time", money("cost").alias("cost"))
    return rows.groupBy("project_id", "description", "sku_id", "sku_description",
                        "usage_start_time", "usage_end_time").agg(
        F.min("export_time").alias("first_export"),
        F.max("export_time").alias("last_export"),
        F.round(F.sum("cost"), 5).cast("double").alias("total_cost"))


def last_n_charges(billing: DataFrame, as_of: datetime, min_charge: float = C.MIN_CHARGE,
                   depth: int = C.CHARGE_DEPTH, ordered: bool = True) -> DataFrame:
    """The ``depth`` newest usage slots of every SKU; slots tied at the boundary all stay.

    Ranking runs over the summed slots, and ranks beyond the depth are cut
    before the shuffle as well as after it.
    """
    newest = W.partitionBy(*_SKU).orderBy(F.desc("usage_end_time"))
    ranked = charge_slots(billing, min_charge).withColumn("rank", F.rank().over(newest)).where(
        F.col("rank") <= depth)
    out = ranked.withColumn("delay_seconds", seconds_between("usage_end_time", instant(as_of)))
    if not ordered:
        return out
    return out.orderBy(*_SKU, F.desc("usage_start_time"), "description", "sku_description", "usage_end_time")


def recent_slots(billing: DataFrame, as_of: datetime, min_charge: float = C.MIN_CHARGE) -> DataFrame:
    """Every reported usage slot that starts within the hours the estimate covers, however many there are."""
    first = as_of.replace(minute=0, second=0, microsecond=0) - timedelta(hours=C.USAGE_SLOTS - 1)
    return charge_slots(billing.where(F.col("usage_start_time") >= instant(first)), min_charge)


def charge_history(charges: DataFrame) -> DataFrame:
    """Newest-first list of the ranked slots of every SKU.

    ``charges`` is already cut to a few slots per SKU, which bounds the list.
    """
    slot = F.struct("usage_start_time", "usage_end_time", "total_cost", "description", "sku_description",
                    "first_export", "last_export", "delay_seconds")
    return charges.groupBy(*_SKU).agg(F.sort_array(F.collect_list(slot), asc=False).alias("history"))


def estimate_burn_from_history(history: DataFrame) -> DataFrame:
    """Cost and end of the newest complete slot.

    With three slots or more, a newest slot below the two before it is taken as
    not fully reported yet, and the second newest is used.
    """
    cost = lambda i: F.element_at("history", i)["total_cost"]
    partial = (F.size("history") >= 3) & F.when(F.size("history") >= 3, (cost(1) < cost(2)) & (cost(1) < cost(3)))
    pick = F.when(partial, F.get("history", F.lit(1))).otherwise(F.get("history", F.lit(0)))
    return history.select(*_SKU, F.size("history").alias("slots"), pick["total_cost"].alias("slot_cost"),
                          pick["usage_end_time"].alias("usage_end_time"))


def reconcile_charges(calc: DataFrame, charges: DataFrame) -> DataFrame:
    """Estimated next to reported cost per project, hour and SKU.

    Both sides are summed by one aggregate over their union, which is the full
    outer join with a single shuffle, and keeps only numbers, so it hashes. A
    description seen anywhere for a project's SKU describes all its hours; it is
    taken from the reported side, one row per SKU, and joined last.
    """
    estimated = calc.select("project_id", "usage_hour", "sku_id", "calc", F.lit(0.0).alias("reported"))
    reported = charges.select("project_id", hour_floor("usage_start_time").alias("usage_hour"), "sku_id",
                              F.lit(0.0).alias("calc"), F.col("total_cost").alias("reported"))
    cells = estimated.unionByName(reported).groupBy("project_id", "usage_hour", "sku_id").agg(
        F.sum("calc").alias("calc"), F.sum("reported").alias("reported"))
    # a SKU has few descriptions, so its set is small
    described = (charges.select(*_SKU, "sku_description").distinct().groupBy(*_SKU)
                 .agg(F.array_min(F.collect_set("sku_description")).alias("_text")))
    return cells.join(described, _SKU, "left").select(
        "project_id", "usage_hour", "sku_id", F.coalesce("_text", F.lit(C.NO_DESCRIPTION)).alias("sku_description"),
        "calc", "reported", (F.col("calc") - F.col("reported")).alias("delta"),
    ).where((F.col("calc") != 0) | (F.col("reported") != 0))


def additional_fees(cells: DataFrame) -> DataFrame:
    """Estimated cost not reported yet: the positive deltas of each project."""
    return cells.groupBy("project_id").agg(
        F.sum(F.greatest(F.col("delta"), F.lit(0.0))).alias("additional_fees"))


def per_hour_charge(calc: DataFrame, as_of: datetime) -> DataFrame:
    """Estimated cost of the last full hour of each project."""
    last_full = hour_floor(instant(as_of)) - F.expr("interval 1 hour")
    return calc.where(F.col("usage_hour") == last_full).groupBy("project_id").agg(
        F.sum("calc").alias("per_hour_charge"))


def interval_costs(alerts: DataFrame) -> DataFrame:
    """Newest cost of each budget interval, by event time, not arrival."""
    order = F.struct("event_time", "message_id")
    return alerts.groupBy("project_id", "interval_start").agg(
        F.max_by(F.struct("cost", "budget"), order).alias("_m"), F.max(order).alias("_o")).select(
        "project_id", "interval_start", "_m.cost", "_m.budget", "_o.event_time", "_o.message_id")


def cumulative_spend(intervals: DataFrame) -> DataFrame:
    """Sum over all budget intervals of each project, and the newest budget amount.

    ``intervals`` is ``interval_costs`` of alerts, or the merged state of a stream.
    """
    order = F.struct("event_time", "message_id")
    return intervals.groupBy("project_id").agg(
        F.sum(money("cost")).cast("double").alias("reported_spend"), F.max_by("budget", order).alias("budget"))


def budget_status(spend: DataFrame, fees: DataFrame, hourly: DataFrame) -> DataFrame:
    """Spend against budget, and the hours left at the current rate.

    Hours left is NULL once the budget is gone, or while nothing runs.
    """
    rows = spend.join(fees, "project_id", "left").join(hourly, "project_id", "left")
    fee = F.coalesce("additional_fees", F.lit(0.0))
    return (
        rows.select("project_id", "budget", "reported_spend", fee.alias("additional_fees"),
                    (F.col("reported_spend") + fee).alias("total_spend"), "per_hour_charge")
        .withColumn("fraction", F.try_divide("total_spend", "budget"))
        .withColumn("remaining", F.col("budget") - F.col("total_spend"))
        .withColumn("hours_left", F.when(F.col("remaining") > 0, F.try_divide("remaining", "per_hour_charge")))
        .withColumn("over_budget", F.coalesce(F.col("fraction") >= 1.0, F.lit(False)))
    )


def budget_message(status: DataFrame) -> DataFrame:
    """Status line of each project, and the hours-left line where there is one."""
    message = F.format_string("%s: budget $%.2f, charged $%.2f with $%.2f of it still to be reported, used share %.4f",
                              "project_id", "budget", "total_spend", "additional_fees", "fraction")
    left = F.when(F.col("hours_left").isNotNull(), F.format_string(
        "%s: budget lasts for another %.2f hours", "project_id", "hours_left"))
    return status.select("project_id", message.alias("message"), left.alias("hours_left_message"))


def cost_log(messages: DataFrame) -> DataFrame:
    """One log line per row, in the order of ``line_no`` within a project."""
    lines = messages.select("project_id", F.posexplode(F.array("message", "hours_left_message")).alias("line_no", "line"))
    return lines.where(F.col("line").isNotNull())
