"""The budget controller: every project's decision in one run."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.keys import instant
from tallyforge.operators import billing as B
from tallyforge.operators import control as K
from tallyforge.operators import estimate as E
from tallyforge.operators import inventory as I
from tallyforge.operators import lookup as L
from tallyforge.operators.projects import join_project
from tallyforge.session import settle
from tallyforge.sources.exports import scan_billing_export
from tallyforge.sources.state import read_runs, save_run


@dataclass(frozen=True)
class Limits:
    """Thresholds of the alerts."""

    max_cpus: int = 8
    egress_multiplier: float = 0.5
    pull_multiplier: float = 1.5


@dataclass(frozen=True)
class Inputs:
    """Domain tables of a run.

    ``billing`` is the whole export; each step reads the part it needs (None: for steps that read no charges).
    ``listed_vms`` and ``listed_disks`` are what the last listing showed; state
    that it lacks is pruned (None: everything is still there). The cards are
    those written with the price tables, made anew where they are None.
    """

    vms: DataFrame
    disks: DataFrame
    billing: DataFrame | None
    alerts: DataFrame
    settings: DataFrame
    prices: dict[str, DataFrame]
    mappings: dict[str, DataFrame]
    listed_vms: DataFrame | None = None
    listed_disks: DataFrame | None = None
    cards: DataFrame | None = None
    disk_card: DataFrame | None = None


_CARRY = ("status", "started", "last_stop")


def enabled_only(inputs: Inputs) -> Inputs:
    """The run without machines and disks of projects that have compute switched off."""
    on = inputs.settings.where("compute_enabled").select("project_id").distinct()
    return replace(inputs, vms=join_project(inputs.vms, on, "left_semi", "vm_id"),
                   disks=join_project(inputs.disks, on, "left_semi", "disk_id"))


def listed_only(inputs: Inputs) -> Inputs:
    """The run without machines and disks that the last listing no longer shows."""
    vms, disks = inputs.vms, inputs.disks
    if inputs.listed_vms is not None:
        vms = I.prune_vms(vms, inputs.listed_vms)
    if inputs.listed_disks is not None:
        disks = I.prune_disks(disks, inputs.listed_disks)
    return replace(inputs, vms=vms, disks=disks)


def priced(inputs: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rate card, priced rows of machines and of disks."""
    card = L.rate_card(inputs.vms, inputs.prices, inputs.mappings, fixed=inputs.cards)
    disks = L.disk_skus(inputs.disks, inputs.prices["pd"], inputs.mappings["pd_key_to_pd"], carry=("created",), card=inputs.disk_card)
    return card, L.vm_skus(inputs.vms, card, carry=_CARRY), disks


def estimated_costs(inputs: Inputs, as_of: datetime, include_stopped: bool = False) -> DataFrame:
    """Estimated cost per project, hour and SKU of everything inventoried and priced in the right unit."""
    _, machines, disks = priced(inputs)
    return E.hourly_cost_per_sku(machines, disks, as_of, include_stopped)


def burn_rates(inputs: Inputs, as_of: datetime) -> DataFrame:
    """Cost since start, in the last day and per hour of every project."""
    _, machines, disks = priced(inputs)
    return E.project_burn(E.machine_cost_intervals(machines, as_of), E.disk_cost_intervals(disks, as_of), inputs.vms)


def reconciliation(inputs: Inputs, calc: DataFrame, as_of: datetime) -> DataFrame:
    """Estimated next to reported cost of every slot in the hours that the estimate covers."""
    return B.reconcile_charges(calc, B.recent_slots(scan_billing_export(inputs.billing, as_of), as_of))


def project_status(inputs: Inputs, as_of: datetime, calc: DataFrame | None = None,
                   spend: DataFrame | None = None) -> DataFrame:
    """Spend, fees to come, fraction and hours left of every project with a budget.

    The estimate feeds two branches, so it is settled once. ``spend`` may come
    from the state a stream maintains instead of the messages.
    """
    if calc is None:
        calc = settle(estimated_costs(inputs, as_of), "estimated-costs")
    if spend is None:
        spend = B.cumulative_spend(B.interval_costs(inputs.alerts))
    fees = B.additional_fees(reconciliation(inputs, calc, as_of))
    return B.budget_status(spend, fees, B.per_hour_charge(calc, as_of))


def current_alerts(inputs: Inputs, status: DataFrame, limits: Limits, as_of: datetime) -> DataFrame:
    """Alerts of all four kinds, dated with the run; transfer charges count over the whole export."""
    exported = scan_billing_export(inputs.billing, as_of, lookback=None)
    alerts = [
        K.egress_alert(B.egress_total(exported), status, limits.egress_multiplier),
        K.over_budget_alert(status),
        K.cpu_cap_alert(I.running_cpus(inputs.vms), limits.max_cpus).drop("excess"),
        K.pull_billing_alert(status, limits.pull_multiplier),
    ]
    return reduce(DataFrame.unionByName, alerts).withColumn(
        "event_time", instant(as_of))


def excess_stops(vms: DataFrame, limits: Limits) -> DataFrame:
    """VMs to stop in projects above the CPU cap."""
    over = K.cpu_cap_alert(I.running_cpus(vms), limits.max_cpus)
    return K.shutdown_list(vms, over.select("project_id", F.col("excess").alias("stop_count")))


def decisions(inputs: Inputs, status: DataFrame, limits: Limits) -> DataFrame:
    """Actions per project."""
    cpus = I.running_cpus(inputs.vms)
    over_cap = K.cpu_cap_alert(cpus, limits.max_cpus)
    return K.action_plan(status, cpus, inputs.settings, over_cap, limits.pull_multiplier)


def control_run(inputs: Inputs, as_of: datetime, limits: Limits, out: str, run: int,
                spend: DataFrame | None = None, estimate_only: bool = False) -> dict[str, DataFrame]:
    """One controller run over all projects; every result is a table below ``out``.

    What the run leaves out of the costs is a table too: ``unpriced`` has the
    requests that no price answers, ``unusable_prices`` those priced in another
    unit. With ``estimate_only`` nothing is decided: no budget, alert or stop.

    Alerts already fired this week, by any run before ``run``, stay silent; a
    repeated run decides as it did the first time. Fired alerts are stored by
    week, runs below, and only this week's folder is listed.
    """
    spark = inputs.vms.sparkSession
    inputs = listed_only(enabled_only(inputs))
    # every later step reads the pruned state
    inputs = replace(inputs, vms=settle(inputs.vms, "run-vms"), disks=settle(inputs.disks, "run-disks"))

    def keep(name: str, df: DataFrame) -> DataFrame:
        return save_run(df, f"{out}/{name}", run)

    card, machines, disks = priced(inputs)
    unpriced = L.unpriced_resources(inputs.vms, card).unionByName(
        L.unpriced_disks(inputs.disks, inputs.prices["pd"], inputs.mappings["pd_key_to_pd"], inputs.disk_card))
    calc = keep("estimated_costs", E.hourly_cost_per_sku(machines, disks, as_of))
    cells = keep("reconciliation", reconciliation(inputs, calc, as_of))
    estimates = {
        "estimated_costs": calc,
        "reconciliation": cells,
        "unpriced": keep("unpriced", unpriced),
        "unusable_prices": keep("unusable_prices", E.unusable_prices(machines, disks)),
    }
    if estimate_only:
        return estimates
    if spend is None:
        spend = B.cumulative_spend(B.interval_costs(inputs.alerts))
    status = keep("budget_status", B.budget_status(spend, B.additional_fees(cells), B.per_hour_charge(calc, as_of)))
    raised = current_alerts(inputs, status, limits, as_of)
    year, week, _ = as_of.isocalendar()
    this_week = f"alerts/iso_year={year}/iso_week={week}"
    fired = read_runs(spark, f"{out}/{this_week}", K.with_iso_week(raised).schema).where(F.col("version") < run)
    actions = keep("actions", decisions(inputs, status, limits))
    full = actions.where("action = 'STOP_ALL_VMS'").select("project_id")
    excess = actions.where("action = 'STOP_EXCESS'").select("project_id")
    stops = K.shutdown_list(join_project(inputs.vms, full, "left_semi", "vm_id")).unionByName(
        join_project(excess_stops(inputs.vms, limits), excess, "left_semi", "vm_id"))
    return {
        **estimates,
        "budget_status": status,
        "alerts": keep(this_week, K.weekly_throttle(raised, fired)),
        "actions": actions,
        "stops": keep("stops", K.stops_by_zone(stops)),
        "cost_log": keep("cost_log", B.cost_log(B.budget_message(status))),
    }
