"""Queries for billing analytics and decisions (2.8)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import billing as B
from tallyforge.operators import control as K
from tallyforge.operators import inventory as I
from tallyforge.plans import budget
from tallyforge.session import scratch_path, settle
from tallyforge.sources.exports import scan_billing_export
from tallyforge.sources.sinks import write_cost_log
from tallyforge.workload import adapters as A
from tallyforge.workload.oracle_base import NOW, OF_RUN, ts
from tallyforge.workload.landing import billing_export, current_vms, listed_disks, listed_state
from tallyforge.workload.q_lookup import UNPRICED_SQL, inputs
from tallyforge.workload.registry import query, rounded

LIMITS = budget.Limits(max_cpus=24, egress_multiplier=3.0, pull_multiplier=1.05)

# --- 2.7 ------------------------------------------------------------------------


@query("egress_costs", """SELECT project_id, project_name, service, sku_description AS sku,
  CAST(sum(CAST(cost AS DECIMAL(28, 9))) AS DOUBLE) AS total_cost, CAST(sum(CAST(usage_amount AS DECIMAL(28, 9))) AS DOUBLE)
  AS total_usage, usage_unit, invoice_month AS invoice_yyyymm FROM billing_flat
  WHERE sku_description LIKE '%ownload%' OR sku_description LIKE '%gress%' GROUP BY ALL ORDER BY total_cost DESC""")
def egress_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.egress_costs(A.billing_export(spark, sf_dir))


@query("egress_total", """SELECT project_id, coalesce(total_egress, 0) AS total_egress
  FROM settings_flat LEFT JOIN egress USING (project_id)""")
def egress_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.egress_total(A.billing_export(spark, sf_dir), A.project_settings(spark, sf_dir))


def _charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.last_n_charges(scan_billing_export(billing_export(spark, sf_dir), A.AS_OF), A.AS_OF, ordered=False)


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.recent_slots(scan_billing_export(billing_export(spark, sf_dir), A.AS_OF), A.AS_OF)


_CHARGE_COLUMNS = f"""project_id, description, sku_id, sku_description, {ts('usage_start_time')}, {ts('usage_end_time')},
  {ts('first_export')}, {ts('last_export')}, total_cost, rank, delay_seconds"""


@query("last_n_charges", f"SELECT {_CHARGE_COLUMNS} FROM charges".replace(" rank,", " CAST(rank AS INTEGER) AS rank,"))
def last_n_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.last_n_charges(scan_billing_export(billing_export(spark, sf_dir), A.AS_OF), A.AS_OF)


@query("last_n_charges_all_time", f"""SELECT project_id, sku_id, {ts('usage_start_time')}, {ts('usage_end_time')},
  CAST(round(sum(CAST(cost AS DECIMAL(28, 9))), 5) AS DOUBLE) AS total_cost, CAST(rank() OVER (
    PARTITION BY project_id, sku_id ORDER BY usage_end_time DESC) AS INTEGER) AS rank FROM billing_flat
  WHERE cost > 1000 AND export_time <= {NOW} GROUP BY project_id, service, sku_id, sku_description, usage_start_time, usage_end_time
  QUALIFY rank <= 3""")
def last_n_charges_all_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = scan_billing_export(billing_export(spark, sf_dir), A.AS_OF, lookback=None)
    return B.last_n_charges(seen, A.AS_OF, min_charge=1000.0, depth=3, ordered=False).select(
        "project_id", "sku_id", "usage_start_time", "usage_end_time", "total_cost", "rank")


@query("charge_history", """SELECT project_id, sku_id, string_agg(strftime(usage_start_time, '%m-%dT%H') || '=' ||
  printf('%.5f', total_cost), ' ' ORDER BY usage_start_time DESC, usage_end_time DESC, total_cost DESC) AS history
  FROM charges GROUP BY ALL""")
def charge_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda s: F.concat(F.date_format(s["usage_start_time"], "MM-dd'T'HH"), F.lit("="),
                              F.format_string("%.5f", s["total_cost"]))
    return B.charge_history(_charges(spark, sf_dir)).withColumn("history", F.array_join(F.transform("history", text), " "))


@query("estimate_burn_from_history", f"""SELECT project_id, sku_id, CAST(len(h) AS INTEGER) AS slots,
  CASE WHEN len(h) >= 3 AND h[1].c < h[2].c AND h[1].c < h[3].c THEN h[2].c ELSE h[1].c END AS slot_cost,
  {ts('CASE WHEN len(h) >= 3 AND h[1].c < h[2].c AND h[1].c < h[3].c THEN h[2].e ELSE h[1].e END', 'usage_end_time')}
  FROM (SELECT project_id, sku_id, list({{'c': total_cost, 'e': usage_end_time}} ORDER BY usage_start_time DESC,
  usage_end_time DESC, total_cost DESC) AS h FROM charges GROUP BY ALL)""")
def estimate_burn_from_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.estimate_burn_from_history(B.charge_history(_charges(spark, sf_dir)))


def _calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(budget.estimated_costs(inputs(spark, sf_dir, billing=False), A.AS_OF), "estimated-costs")


@query("reconcile_charges", f"""SELECT project_id, {ts('usage_hour')}, sku_id, sku_description, round(calc, 8) AS calc,
  round(reported, 8) AS reported, round(delta, 8) AS delta FROM reconciled""")
def reconcile_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = B.reconcile_charges(_calc(spark, sf_dir), _recent(spark, sf_dir))
    return rounded(cells, "calc", "reported", "delta", digits=8)


@query("additional_fees", "SELECT project_id, round(additional_fees, 4) AS additional_fees FROM fees")
def additional_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = B.reconcile_charges(_calc(spark, sf_dir), _recent(spark, sf_dir))
    return rounded(B.additional_fees(cells), "additional_fees", digits=4)


@query("per_hour_charge", "SELECT project_id, round(per_hour_charge, 4) AS per_hour_charge FROM hourly")
def per_hour_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.per_hour_charge(_calc(spark, sf_dir), A.AS_OF), "per_hour_charge", digits=4)


@query("cumulative_spend", "SELECT * FROM spend")
def cumulative_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.cumulative_spend(B.interval_costs(A.budget_alerts(spark, sf_dir)))


_STATUS_ROUNDED = ("additional_fees", "total_spend", "per_hour_charge", "remaining", "hours_left")


@query("budget_status", "SELECT project_id, budget, reported_spend, " + ", ".join(
    f"round({c}, 3) AS {c}" for c in _STATUS_ROUNDED) + ", round(fraction, 8) AS fraction, over_budget FROM status")
def budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = budget.project_status(inputs(spark, sf_dir), A.AS_OF)
    return rounded(rounded(status, *_STATUS_ROUNDED, digits=3), "fraction", digits=8)


_MESSAGE_SQL = """printf('%s: budget $%.2f, charged $%.2f with $%.2f of it still to be reported, used share %.4f', project_id, budget, round(total_spend, 4), round(additional_fees, 4), round(fraction, 7))"""
_LEFT_SQL = """CASE WHEN hours_left IS NOT NULL THEN printf('%s: budget lasts for another %.2f hours', project_id,
  round(hours_left, 5)) END"""


def _printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = budget.project_status(inputs(spark, sf_dir), A.AS_OF)
    status = rounded(status, "total_spend", "additional_fees", digits=4)
    return rounded(rounded(status, "fraction", digits=7), "hours_left", digits=5)


@query("budget_message", f"SELECT project_id, {_MESSAGE_SQL} AS message, {_LEFT_SQL} AS hours_left_message FROM status")
def budget_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.budget_message(_printable(spark, sf_dir))


@query("cost_log", f"""SELECT line FROM (SELECT {_MESSAGE_SQL} AS line FROM status
  UNION ALL SELECT {_LEFT_SQL} FROM status) WHERE line IS NOT NULL""")
def cost_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "cost-log")
    write_cost_log(B.cost_log(B.budget_message(_printable(spark, sf_dir))), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# --- 2.8 ------------------------------------------------------------------------

_OVER_CAP = f"(SELECT project_id, total_cpus - {LIMITS.max_cpus} AS excess FROM cpus WHERE total_cpus > {LIMITS.max_cpus})"
_STOP_SQL = f"""SELECT project_id, zone, vm_id, name, cpus, started, cpus_before FROM (
  SELECT v.*, excess, coalesce(sum(cpus) OVER (PARTITION BY project_id ORDER BY started DESC, substr(md5(vm_id), 1, 3), vm_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cpus_before
  FROM vms AS v JOIN {_OVER_CAP} AS x USING (project_id) WHERE status = 'RUNNING') WHERE cpus_before <= excess"""


@query("egress_alert", f"""SELECT project_id, '1' AS alert, total_egress AS value, {LIMITS.egress_multiplier} * budget AS threshold
  FROM egress JOIN spend USING (project_id) WHERE total_egress > {LIMITS.egress_multiplier} * budget""")
def egress_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = B.cumulative_spend(B.interval_costs(A.budget_alerts(spark, sf_dir)))
    return K.egress_alert(B.egress_total(A.billing_export(spark, sf_dir)), spend, LIMITS.egress_multiplier)


@query("over_budget_alert", """SELECT project_id, '2' AS alert, round(fraction, 8) AS value, CAST(1 AS DOUBLE) AS threshold
  FROM status WHERE over_budget""")
def over_budget_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.over_budget_alert(budget.project_status(inputs(spark, sf_dir), A.AS_OF)), "value", digits=8)


@query("cpu_cap_alert", f"""SELECT project_id, '3' AS alert, total_cpus AS value, CAST({LIMITS.max_cpus} AS DOUBLE) AS threshold,
  total_cpus - {LIMITS.max_cpus} AS excess FROM cpus WHERE total_cpus > {LIMITS.max_cpus}""")
def cpu_cap_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cpu_cap_alert(I.running_cpus(current_vms(spark, sf_dir)), LIMITS.max_cpus)


@query("pull_billing_alert", f"""SELECT project_id, '4' AS alert, round(fraction, 8) AS value,
  CAST({LIMITS.pull_multiplier} AS DOUBLE) AS threshold FROM status WHERE over_budget AND fraction >= {LIMITS.pull_multiplier}""")
def pull_billing_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = budget.project_status(inputs(spark, sf_dir), A.AS_OF)
    return rounded(K.pull_billing_alert(status, LIMITS.pull_multiplier), "value", digits=8)


def message_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts raised by single messages: over a share of the budget, and the largest also of kind 4."""
    kinds = F.array(F.when(F.col("cost") > 0.008 * F.col("budget"), F.lit("2")), F.when(F.col("cost") > 0.02 * F.col("budget"), F.lit("4")))
    return alerts.select("project_id", F.explode(F.array_compact(kinds)).alias("alert"), "event_time",
                         F.col("cost").alias("value"), "message_id")


_MESSAGE_ALERTS = """(SELECT project_id, '2' AS alert, event_time, cost AS value, message_id FROM alerts_flat WHERE cost > 0.008 * budget
  UNION ALL SELECT project_id, '4', event_time, cost, message_id FROM alerts_flat WHERE cost > 0.02 * budget)"""


@query("weekly_throttle", f"""SELECT project_id, alert, {ts('event_time')}, value, message_id, CAST(iso_year AS INTEGER) AS iso_year,
  CAST(iso_week AS INTEGER) AS iso_week FROM (SELECT *, isoyear(event_time) AS iso_year, weekofyear(event_time) AS iso_week,
    row_number() OVER (PARTITION BY project_id, alert, isoyear(event_time), weekofyear(event_time)
      ORDER BY event_time, value, message_id) AS rn FROM {_MESSAGE_ALERTS}) WHERE alert NOT IN ('1', '2') OR rn = 1""")
def weekly_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.weekly_throttle(message_alerts(A.budget_alerts(spark, sf_dir)))


@query("current_alerts", f"""SELECT project_id, '1' AS alert FROM (SELECT project_id, CAST(sum(CAST(cost AS DECIMAL(28, 9))) AS DOUBLE)
    AS total_egress FROM billing_flat WHERE export_time <= {NOW} AND (sku_description LIKE '%ownload%' OR sku_description LIKE '%gress%') GROUP BY ALL)
    JOIN status USING (project_id) WHERE total_egress > {LIMITS.egress_multiplier} * budget
  UNION ALL SELECT project_id, '2' FROM status WHERE over_budget
  UNION ALL SELECT project_id, '3' FROM cpus WHERE total_cpus > {LIMITS.max_cpus}
  UNION ALL SELECT project_id, '4' FROM status WHERE over_budget AND fraction >= {LIMITS.pull_multiplier}""")
def current_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inputs(spark, sf_dir)
    status = settle(budget.project_status(i, A.AS_OF), "status")
    return K.weekly_throttle(budget.current_alerts(i, status, LIMITS, A.AS_OF)).select("project_id", "alert")


@query("shutdown_list", f"""SELECT project_id, zone, vm_id, name, cpus, {ts('started')}, cpus_before FROM ({_STOP_SQL})""")
def shutdown_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.excess_stops(current_vms(spark, sf_dir), LIMITS)


def _chunk_sql(max_names: int) -> str:
    return f"""SELECT project_id, zone, name, CAST(('0x' || substr(md5(name), 1, 8)) AS BIGINT) % CAST(ceil(count(*) OVER (
    PARTITION BY project_id, zone) / {max_names}.0) AS BIGINT) AS chunk FROM vms WHERE status = 'RUNNING'"""


@query("stops_by_zone", _chunk_sql(1000))
def stops_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All running VMs."""
    return K.stops_by_zone(K.shutdown_list(current_vms(spark, sf_dir)))


@query("stops_by_zone_chunked", _chunk_sql(4))
def stops_by_zone_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.stops_by_zone(K.shutdown_list(current_vms(spark, sf_dir)), max_names=4)


_ACTION_SQL = f"""SELECT project_id, action FROM (
  SELECT project_id, 'STOP_ALL_VMS' AS action FROM status JOIN cpus USING (project_id) WHERE over_budget
  UNION ALL SELECT project_id, 'STOP_APP' FROM status JOIN settings_flat USING (project_id) WHERE over_budget AND has_app
  UNION ALL SELECT project_id, 'DETACH_BILLING' FROM status WHERE over_budget AND fraction >= {LIMITS.pull_multiplier}
  UNION ALL SELECT project_id, 'STOP_EXCESS' FROM status JOIN cpus USING (project_id)
    WHERE NOT over_budget AND total_cpus > {LIMITS.max_cpus}
  UNION ALL SELECT project_id, 'NONE' FROM status LEFT JOIN cpus USING (project_id) LEFT JOIN settings_flat USING (project_id)
    WHERE (NOT over_budget AND coalesce(total_cpus, 0) <= {LIMITS.max_cpus}) OR (over_budget AND total_cpus IS NULL
      AND NOT coalesce(has_app, false) AND fraction < {LIMITS.pull_multiplier}))"""


@query("action_plan", _ACTION_SQL)
def action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inputs(spark, sf_dir)
    return budget.decisions(i, budget.project_status(i, A.AS_OF), LIMITS).select("project_id", "action")


# --- every table of a controller run --------------------------------------------

_RUNS: dict[tuple[str, str, bool], dict[str, DataFrame]] = {}


def _run(spark: SparkSession, sf_dir: str, estimate_only: bool = False) -> dict[str, DataFrame]:
    """The tables of one run, made once per session and read by a query each."""
    key = (spark.sparkContext.applicationId, sf_dir, estimate_only)
    if key not in _RUNS:
        _RUNS[key] = budget.control_run(run_inputs(spark, sf_dir), A.AS_OF, LIMITS, scratch_path(spark, "control"), 1,
                                        estimate_only=estimate_only)
    return _RUNS[key]


def run_inputs(spark: SparkSession, sf_dir: str) -> budget.Inputs:
    """What a run starts from: the state brought up to date, and the disks that the last listing shows."""
    return replace(inputs(spark, sf_dir, vms=listed_state), listed_disks=listed_disks(spark, sf_dir))


def _run_query(name: str, sql: str):
    return query(name, sql, replaced=OF_RUN)


@_run_query("control_run", f"""SELECT project_id, zone, name FROM (
  SELECT project_id, zone, name FROM vms JOIN status USING (project_id) WHERE vms.status = 'RUNNING' AND over_budget
  UNION ALL SELECT s.project_id, s.zone, s.name FROM ({_STOP_SQL}) AS s JOIN status USING (project_id) WHERE NOT over_budget)""")
def control_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of a controller run, down to the machines it stops."""
    return _run(spark, sf_dir)["stops"].select("project_id", "zone", "name")


@query("prune_listed_disks", "SELECT project_id, disk_id, size_gb FROM disks_flat",
       replaced={"disks_flat": A.disks_flat(A.of_some("customer", A.DISK_STAYS))})
def prune_listed_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known disks that the last listing still shows."""
    known = A.disk_inventory(spark, sf_dir)
    return I.prune_disks(known, listed_disks(spark, sf_dir)).select("project_id", "disk_id", "size_gb")


_ALERT_SQL = f"""SELECT project_id, '1' AS alert FROM (SELECT project_id, CAST(sum(CAST(cost AS DECIMAL(28, 9))) AS DOUBLE)
    AS total_egress FROM billing_flat WHERE export_time <= {NOW} AND (sku_description LIKE '%ownload%' OR sku_description LIKE '%gress%')
    GROUP BY ALL) JOIN status USING (project_id) WHERE total_egress > {LIMITS.egress_multiplier} * budget
  UNION ALL SELECT project_id, '2' FROM status WHERE over_budget
  UNION ALL SELECT project_id, '3' FROM cpus WHERE total_cpus > {LIMITS.max_cpus}
  UNION ALL SELECT project_id, '4' FROM status WHERE over_budget AND fraction >= {LIMITS.pull_multiplier}"""


@_run_query("control_run_estimated_costs", f"SELECT project_id, {ts('usage_hour')}, sku_id, round(calc, 8) AS calc FROM calc")
def control_run_estimated_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_run(spark, sf_dir)["estimated_costs"], "calc", digits=8)


@_run_query("control_run_reconciliation", f"""SELECT project_id, {ts('usage_hour')}, sku_id, sku_description, round(calc, 8) AS calc,
  round(reported, 8) AS reported, round(delta, 8) AS delta FROM reconciled""")
def control_run_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_run(spark, sf_dir)["reconciliation"], "calc", "reported", "delta", digits=8)


@_run_query("control_run_status", "SELECT project_id, budget, reported_spend, " + ", ".join(
    f"round({c}, 3) AS {c}" for c in _STATUS_ROUNDED) + ", round(fraction, 8) AS fraction, over_budget FROM status")
def control_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(_run(spark, sf_dir)["budget_status"], *_STATUS_ROUNDED, digits=3), "fraction", digits=8)


@_run_query("control_run_alerts", f"""SELECT project_id, '1' AS alert, round(total_egress, 6) AS value,
    round({LIMITS.egress_multiplier} * budget, 6) AS threshold FROM (SELECT project_id, CAST(sum(CAST(cost AS DECIMAL(28, 9))) AS DOUBLE)
    AS total_egress FROM billing_flat WHERE export_time <= {NOW} AND (sku_description LIKE '%ownload%' OR sku_description LIKE '%gress%')
    GROUP BY ALL) JOIN status USING (project_id) WHERE total_egress > {LIMITS.egress_multiplier} * budget
  UNION ALL SELECT project_id, '2', round(fraction, 6), 1.0 FROM status WHERE over_budget
  UNION ALL SELECT project_id, '3', round(total_cpus, 6), {LIMITS.max_cpus} FROM cpus WHERE total_cpus > {LIMITS.max_cpus}
  UNION ALL SELECT project_id, '4', round(fraction, 6), {LIMITS.pull_multiplier} FROM status
    WHERE over_budget AND fraction >= {LIMITS.pull_multiplier}""")
def control_run_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_run(spark, sf_dir)["alerts"].select("project_id", "alert", "value", "threshold"), "value", "threshold")


@_run_query("control_run_actions", f"{_ACTION_SQL}")
def control_run_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)["actions"].select("project_id", "action")


@_run_query("control_run_cost_log", f"""SELECT project_id, CAST(0 AS INTEGER) AS line_no, {_MESSAGE_SQL} AS line FROM status
  UNION ALL SELECT project_id, CAST(1 AS INTEGER), {_LEFT_SQL} FROM status WHERE hours_left IS NOT NULL""")
def control_run_cost_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)["cost_log"]


@_run_query("control_run_unpriced", UNPRICED_SQL)
def control_run_unpriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)["unpriced"].drop("request_key")


@_run_query("control_run_unusable_prices", """SELECT project_id, vm_id AS resource_id, component, sku_id, unit FROM vm_sku_rows
    EXCEPT ALL SELECT project_id, vm_id, component, sku_id, unit FROM usable_vm_rows
  UNION ALL (SELECT project_id, disk_id, component, sku_id, unit FROM disk_sku_rows
    EXCEPT ALL SELECT project_id, disk_id, component, sku_id, unit FROM usable_disk_rows)""")
def control_run_unusable_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)["unusable_prices"]


@_run_query("control_run_estimate_only", f"""SELECT 'estimated' AS kind, project_id, {ts('usage_hour')}, sku_id, round(calc, 8) AS amount FROM calc
  UNION ALL SELECT 'reported', project_id, {ts('usage_hour')}, sku_id, round(reported, 8) FROM reconciled""")
def control_run_estimate_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that decides nothing: estimates next to what was reported."""
    tables = _run(spark, sf_dir, estimate_only=True)
    rows = tables["estimated_costs"].selectExpr("'estimated' AS kind", "project_id", "usage_hour", "sku_id", "round(calc, 8) AS amount")
    return rows.unionByName(tables["reconciliation"].selectExpr(
        "'reported' AS kind", "project_id", "usage_hour", "sku_id", "round(reported, 8) AS amount"))
