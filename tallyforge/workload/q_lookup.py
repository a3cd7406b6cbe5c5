"""Queries for price lookups, inventory state (2.5) and estimates (2.6)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.keys import hours_between, instant
from tallyforge.operators import estimate as E
from tallyforge.operators import inventory as I
from tallyforge.operators import lookup as L
from tallyforge.plans import budget
from tallyforge.workload import adapters as A
from tallyforge.workload.landing import billing_export, current_vms, listed_state, price_cards, price_tables
from tallyforge.workload.oracle_base import NOW, ts
from tallyforge.workload.registry import query, rounded


def inputs(spark: SparkSession, sf_dir: str, billing: bool = True,
           vms: Callable[[SparkSession, str], DataFrame] = current_vms) -> budget.Inputs:
    """Domain tables of a run, landed where they are not yet; the export only for steps that read charges."""
    cards, disk_card = price_cards(spark, sf_dir)
    return budget.Inputs(
        cards=cards,
        disk_card=disk_card,
        vms=vms(spark, sf_dir),
        disks=A.disk_inventory(spark, sf_dir),
        billing=billing_export(spark, sf_dir) if billing else None,
        alerts=A.budget_alerts(spark, sf_dir),
        settings=A.project_settings(spark, sf_dir),
        prices=price_tables(spark, sf_dir),
        mappings=A.mappings(spark),
    )


def disk_prices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The disks, their prices and the mapping between, for queries that need no machines."""
    return A.disk_inventory(spark, sf_dir), price_tables(spark, sf_dir)["pd"], A.mappings(spark)["pd_key_to_pd"]


# --- 2.4 ------------------------------------------------------------------------


@query("vm_price_lookup", """SELECT project_id, vm_id, machine_key, region, preemptible, cpus_per_core, cpu_sku_id, cpu_max_usd,
  cpu_pricing_unit, ram_sku_id, ram_max_usd, ram_pricing_unit, n_matches FROM vm_price""")
def vm_price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inputs(spark, sf_dir, billing=False)
    priced = L.vm_price_lookup(i.vms, i.prices["cpu"], i.prices["ram"], i.mappings["machine_key_to_cpu"])
    return priced.drop("cpu", "ram", "cpu_min_usd", "ram_min_usd")


@query("gpu_price_lookup", """SELECT project_id, vm_id, CAST(entry AS INTEGER) AS entry, gpu_key,
  CAST(gpu_count AS INTEGER) AS gpu_count, region, preemptible, sku_id, max_usd, min_usd, pricing_unit, n_matches
  FROM gpu_price""")
def gpu_price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inputs(spark, sf_dir, billing=False)
    return L.gpu_price_lookup(i.vms, i.prices["gpu"], i.mappings["gpu_key_to_gpu"])


@query("pd_price_lookup", """SELECT project_id, disk_id, pd_key, region, is_regional, sku_id, max_usd, min_usd,
  pricing_unit, n_matches FROM pd_price""")
def pd_price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pd_price_lookup(*disk_prices(spark, sf_dir))


@query("cpu_lic_lookup", "SELECT * FROM cpu_lic_price")
def cpu_lic_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inputs(spark, sf_dir, billing=False)
    return L.cpu_lic_lookup(i.vms, i.prices["cpu_lic"], i.mappings["lic_key_to_lic"])


@query("gpu_lic_lookup", """SELECT project_id, vm_id, license, CAST(num_gpu AS INTEGER) AS num_gpu, sku_id, max_usd, min_usd,
  pricing_unit, n_matches FROM gpu_lic_price""")
def gpu_lic_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inputs(spark, sf_dir, billing=False)
    return L.gpu_lic_lookup(i.vms, i.prices["gpu_lic"], i.mappings["lic_key_to_lic"])


@query("ram_lic_lookup", "SELECT * FROM ram_lic_price")
def ram_lic_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inputs(spark, sf_dir, billing=False)
    return L.ram_lic_lookup(i.vms, i.prices["ram_lic"], i.mappings["lic_key_to_lic"])


@query("one_price", """SELECT ip_key, preemptible, sku_id, max_usd, min_usd, pricing_unit, n_matches FROM (
  SELECT *, count(*) OVER w AS n_matches, row_number() OVER (PARTITION BY ip_key, preemptible
    ORDER BY max_usd DESC NULLS LAST, sku_id) AS rn FROM p_ip WINDOW w AS (PARTITION BY ip_key, preemptible)) WHERE rn = 1""")
def one_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.one_price(price_tables(spark, sf_dir)["ip"], ["ip_key", "preemptible"])


UNPRICED_SQL = """
SELECT project_id, vm_id AS resource_id, 'vm' AS missing FROM vms WHERE (project_id, vm_id) NOT IN (SELECT (project_id, vm_id) FROM vm_price)
UNION ALL SELECT project_id, vm_id, 'gpu' FROM (SELECT project_id, vm_id, entry FROM accels EXCEPT SELECT project_id, vm_id, entry FROM gpu_price)
UNION ALL SELECT project_id, vm_id, 'cpu_lic' FROM (SELECT project_id, vm_id FROM vms EXCEPT SELECT project_id, vm_id FROM cpu_lic_price)
UNION ALL SELECT project_id, vm_id, 'gpu_lic' FROM (SELECT project_id, vm_id FROM vm_keys WHERE num_gpu > 0
  EXCEPT SELECT project_id, vm_id FROM gpu_lic_price)
UNION ALL SELECT project_id, vm_id, 'ram_lic' FROM (SELECT project_id, vm_id FROM vms EXCEPT SELECT project_id, vm_id FROM ram_lic_price)
UNION ALL SELECT project_id, disk_id, 'disk' FROM (SELECT project_id, disk_id FROM disks_flat EXCEPT SELECT project_id, disk_id FROM pd_price)"""


@query("unpriced_resources", UNPRICED_SQL)
def unpriced_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inputs(spark, sf_dir, billing=False)
    card = L.rate_card(i.vms, i.prices, i.mappings, fixed=i.cards)
    missing = L.unpriced_resources(i.vms, card).unionByName(
        L.unpriced_disks(i.disks, i.prices["pd"], i.mappings["pd_key_to_pd"]))
    return missing.drop("request_key")


@query("vm_skus", "SELECT * FROM vm_sku_rows")
def vm_skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inputs(spark, sf_dir, billing=False)
    return L.vm_skus(i.vms, L.rate_card(i.vms, i.prices, i.mappings, fixed=i.cards))


@query("disk_skus", "SELECT * EXCLUDE (created) FROM disk_sku_rows")
def disk_skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.disk_skus(*disk_prices(spark, sf_dir))


# --- 2.5 ------------------------------------------------------------------------


@query("split_by_status", """SELECT project_id, vm_id, CASE WHEN status = 'RUNNING' THEN 'running' ELSE 'stopped' END AS list
  FROM vms""")
def split_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    running, stopped = I.split_by_status(current_vms(spark, sf_dir))
    return running.select("project_id", "vm_id", F.lit("running").alias("list")).unionByName(
        stopped.select("project_id", "vm_id", F.lit("stopped").alias("list")))


@query("running_cpus", "SELECT * FROM cpus")
def running_cpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.running_cpus(current_vms(spark, sf_dir))


@query("upsert_vms", f"SELECT project_id, vm_id, status, {ts('inventory_time')}, {ts('started')}, {ts('last_stop')} FROM vms")
def upsert_vms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of three days ago, refreshed by everything polled since."""
    snapshots = A.vm_snapshots(spark, sf_dir)
    before = A.AS_OF - timedelta(days=3)
    state = I.latest_vms(snapshots, before)
    news = snapshots.where((F.col("inventory_time") > instant(before)) & (F.col("inventory_time") <= instant(A.AS_OF)))
    return I.upsert_vms(state, news).select("project_id", "vm_id", "status", "inventory_time", "started", "last_stop")


@query("upsert_disks", f"SELECT project_id, disk_id, size_gb + 1 AS size_gb, {ts('created')} FROM disks_flat")
def upsert_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older half of the disks known before; all of them listed again, one gigabyte larger."""
    disks = A.disk_inventory(spark, sf_dir)
    known = disks.where("created < TIMESTAMP '2023-12-15'").withColumn("inventory_time", instant(A.AS_OF - timedelta(hours=1)))
    listed = disks.withColumn("size_gb", F.col("size_gb") + 1).withColumn("inventory_time", instant(A.AS_OF))
    return I.upsert_disks(known, listed).select("project_id", "disk_id", "size_gb", "created")


@query("inventory_state", f"""SELECT project_id, vm_id, status, zone, machine_type, license, cpus, CAST(memory_mb AS INTEGER) AS memory_mb,
  first_disk_size, {ts('started')}, strftime(inventory_time, '%Y-%m-%d %H:%M:%S') AS inventory_time FROM (
  SELECT * REPLACE ({NOW} AS inventory_time) FROM vms WHERE inventory_time >= {NOW} - INTERVAL 2 DAY
  UNION ALL BY NAME SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, vm_id ORDER BY inventory_time DESC) AS rn
    FROM snapshots_flat WHERE inventory_time <= {NOW} - INTERVAL 3 DAY)
    WHERE rn = 1 AND project_id NOT IN (SELECT project_id FROM settings_flat WHERE compute_enabled)
    AND (project_id, vm_id) NOT IN (SELECT (project_id, vm_id) FROM vms WHERE inventory_time >= {NOW} - INTERVAL 2 DAY))""")
def inventory_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to machines with sizes, merged into the state of three days ago, pruned by the listing."""
    return listed_state(spark, sf_dir).select("project_id", "vm_id", "status", "zone", "machine_type", "license", "cpus", "memory_mb",
                                              "first_disk_size", "started", "inventory_time")


@query("prune_vms", f"""SELECT v.project_id, v.vm_id FROM vms AS v JOIN settings_flat AS s ON s.project_id = v.project_id
  WHERE NOT s.compute_enabled OR EXISTS (SELECT 1 FROM snapshots_flat AS c WHERE c.project_id = v.project_id
    AND c.vm_id = v.vm_id AND c.inventory_time <= {NOW} AND c.inventory_time > {NOW} - INTERVAL 2 DAY)""")
def prune_vms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State keeps what was listed in the last two days, and all of disabled projects."""
    snapshots = A.vm_snapshots(spark, sf_dir)
    listed = snapshots.where((F.col("inventory_time") > instant(A.AS_OF - timedelta(days=2)))
                             & (F.col("inventory_time") <= instant(A.AS_OF)))
    enabled = A.project_settings(spark, sf_dir).where("compute_enabled")
    return I.prune_vms(I.latest_vms(snapshots, A.AS_OF), listed, enabled).select("project_id", "vm_id")


@query("prune_disks", f"""SELECT project_id, disk_id FROM disks_flat WHERE CAST(substr(disk_id, 6) AS INT) % 4 <> 1
  OR NOT (SELECT bool_and(s.compute_enabled) FROM settings_flat AS s WHERE s.project_id = disks_flat.project_id)""")
def prune_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth disk is no longer listed."""
    disks = A.disk_inventory(spark, sf_dir)
    listed = disks.where("CAST(substr(disk_id, 6) AS INT) % 4 <> 1")
    enabled = A.project_settings(spark, sf_dir).where("compute_enabled")
    return I.prune_disks(disks, listed, enabled).select("project_id", "disk_id")


@query("uptime_intervals", f"SELECT project_id, vm_id, {ts('start')}, {ts('stop')} FROM intervals")
def uptime_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.uptime_intervals(A.vm_snapshots(spark, sf_dir))


def _known_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = A.vm_snapshots(spark, sf_dir).where(F.col("inventory_time") <= instant(A.AS_OF))
    return I.uptime_intervals(snapshots)


@query("uptime_this_month", "SELECT project_id, vm_id, uptime_minutes FROM month_uptime")
def uptime_this_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.uptime_this_month(_known_intervals(spark, sf_dir), A.AS_OF)


@query("machine_uptime_hours", f"""SELECT project_id, vm_id, (epoch_us({NOW}) - epoch_us(started)) / 3.6e9 AS uptime_hours
  FROM vms WHERE status = 'RUNNING'""")
def machine_uptime_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.machine_uptime_hours(current_vms(spark, sf_dir), A.AS_OF)


@query("sustained_discount", """SELECT project_id, vm_id, machine_type, uptime_minutes,
  coalesce((SELECT arg_max(t.multiplier, t.floor) FROM (VALUES ('n1', 0, 1.0), ('n1', 10950, 0.8), ('n1', 21900, 0.6),
    ('n1', 32850, 0.4), ('n2', 0, 1.0), ('n2', 10950, 0.8678), ('n2', 21900, 0.733), ('n2', 32850, 0.6))
    AS t(class, floor, multiplier) WHERE t.class = split_part(machine_type, '-', 1) AND t.floor < uptime_minutes),
    1.0)::DOUBLE AS multiplier
  FROM month_uptime JOIN vms USING (project_id, vm_id)""")
def sustained_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    uptime = I.uptime_this_month(_known_intervals(spark, sf_dir), A.AS_OF)
    return I.sustained_discount(uptime, current_vms(spark, sf_dir))


_PART_TIERS = """SELECT list_extract(['n1', 'n2', 'e2', 'c2', 'm1'], CAST(p_partkey % 5 AS INTEGER) + 1) AS class,
  CAST(p_size * 600 AS DOUBLE) AS floor, min(1.0 - p_size / 100.0)::DOUBLE AS multiplier FROM part GROUP BY 1, 2"""


@query("sustained_discount_other_tiers", f"""SELECT project_id, vm_id, machine_type, uptime_minutes,
  coalesce((SELECT arg_max(t.multiplier, t.floor) FROM ({_PART_TIERS}) AS t
    WHERE t.class = split_part(machine_type, '-', 1) AND t.floor < uptime_minutes), 1.0)::DOUBLE AS multiplier
  FROM month_uptime JOIN vms USING (project_id, vm_id)""")
def sustained_discount_other_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers as a table of their own: five classes and up to fifty bounds each, from the parts."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    classes = F.array(*[F.lit(c) for c in ("n1", "n2", "e2", "c2", "m1")])
    tiers = part.select(F.get(classes, (F.col("p_partkey") % 5).cast("int")).alias("machine_class"),
                        (F.col("p_size") * 600.0).alias("min_minutes"), (1.0 - F.col("p_size") / 100.0).alias("multiplier"))
    uptime = I.uptime_this_month(_known_intervals(spark, sf_dir), A.AS_OF)
    return I.sustained_discount(uptime, current_vms(spark, sf_dir), tiers)


@query("usage_hours", f"""SELECT project_id, vm_id AS resource_id, {ts('usage_hour')}, minutes FROM vm_usage
  UNION ALL SELECT project_id, disk_id, {ts('usage_hour')}, minutes FROM disk_usage""")
def usage_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    running, _ = I.split_by_status(current_vms(spark, sf_dir))
    vms = I.usage_hours(running, A.AS_OF)
    disks = I.usage_hours(A.disk_inventory(spark, sf_dir), A.AS_OF, ("project_id", "disk_id"), start="created")
    both = vms.withColumnRenamed("vm_id", "resource_id").unionByName(disks.withColumnRenamed("disk_id", "resource_id"))
    return both


@query("inventory_gap", f"""SELECT project_id, {ts('inventory_time')}, CAST(epoch_us(inventory_time) - epoch_us(lag(inventory_time)
  OVER (PARTITION BY project_id ORDER BY inventory_time)) AS BIGINT) // 1000000 AS gap_seconds
  FROM (SELECT DISTINCT project_id, inventory_time FROM snapshots_flat)""")
def inventory_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.inventory_gap(A.vm_snapshots(spark, sf_dir))


# --- 2.6 ------------------------------------------------------------------------


def _costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced components of running VMs with the hours since they started."""
    i = inputs(spark, sf_dir, billing=False)
    running, _ = I.split_by_status(i.vms)
    skus = L.vm_skus(running, L.rate_card(running, i.prices, i.mappings), carry=("started",))
    return skus.withColumn("hours", hours_between("started", instant(A.AS_OF)))


def _component_sql(*components: str) -> str:
    names = ", ".join(f"'{c}'" for c in components)
    return f"""SELECT project_id, vm_id, component, sku_id, (epoch_us({NOW}) - epoch_us(started)) / 3.6e9
  * coalesce(rate, 0) * quantity AS cost FROM vm_sku_rows JOIN vms USING (project_id, vm_id)
  WHERE status = 'RUNNING' AND component IN ({names})"""


@query("check_units", """SELECT project_id, vm_id AS resource_id, component, unit, CASE component WHEN 'ram' THEN unit IS NULL
    OR unit = 'GIBIBYTE_HOUR' WHEN 'ram_lic' THEN unit = 'GIBIBYTE_HOUR' ELSE unit = 'HOUR' END AS unit_ok FROM vm_sku_rows
  UNION ALL SELECT project_id, disk_id, component, unit, unit = 'GIBIBYTE_MONTH' FROM disk_sku_rows""")
def check_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inputs(spark, sf_dir, billing=False)
    vms = L.vm_skus(i.vms, L.rate_card(i.vms, i.prices, i.mappings)).withColumnRenamed("vm_id", "resource_id")
    disks = L.disk_skus(i.disks, i.prices["pd"], i.mappings["pd_key_to_pd"]).withColumnRenamed("disk_id", "resource_id")
    return E.check_units(vms.unionByName(disks)).select("project_id", "resource_id", "component", "unit", "unit_ok")


@query("core_ram_cost", _component_sql("cpu", "ram"))
def core_ram_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.core_ram_cost(_costed(spark, sf_dir))


@query("gpu_cost", _component_sql("gpu"))
def gpu_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gpu_cost(_costed(spark, sf_dir))


@query("license_cost", _component_sql("cpu_lic", "gpu_lic", "ram_lic"))
def license_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.license_cost(_costed(spark, sf_dir))


@query("disk_cost", f"""SELECT project_id, disk_id, sku_id, rate * ((epoch_us({NOW}) - epoch_us(created)) / 3.6e9 / 730.0)
  * quantity AS cost FROM disk_sku_rows""")
def disk_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    skus = L.disk_skus(*disk_prices(spark, sf_dir), carry=("created",))
    return E.disk_cost(skus.withColumn("hours", hours_between("created", instant(A.AS_OF))))


@query("hourly_cost_per_sku", f"SELECT project_id, {ts('usage_hour')}, sku_id, round(calc, 8) AS calc FROM calc")
def hourly_cost_per_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(budget.estimated_costs(inputs(spark, sf_dir, billing=False), A.AS_OF), "calc", digits=8)


@query("hourly_cost_with_stopped", f"""SELECT project_id, {ts('usage_hour')}, sku_id, round(sum(cost), 8) AS calc FROM (
  SELECT project_id, usage_hour, sku_id, cost FROM calc_rows
  UNION ALL SELECT project_id, usage_hour, sku_id, minutes / 60 * coalesce(rate, 0) * quantity
  FROM stopped_usage JOIN usable_vm_rows USING (project_id, vm_id) WHERE sku_id IS NOT NULL)
  GROUP BY project_id, usage_hour, sku_id HAVING sum(cost) <> 0""")
def hourly_cost_with_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(budget.estimated_costs(inputs(spark, sf_dir, billing=False), A.AS_OF, include_stopped=True), "calc", digits=8)


@query("machine_cost_intervals", """SELECT project_id, vm_id, interval, hours, round(cost, 8) AS cost
  FROM vm_intervals""")
def machine_cost_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inputs(spark, sf_dir, billing=False)
    skus = L.vm_skus(i.vms, L.rate_card(i.vms, i.prices, i.mappings), carry=("status", "started"))
    return rounded(E.machine_cost_intervals(skus, A.AS_OF), "cost", digits=8)


@query("disk_cost_intervals", """SELECT project_id, disk_id, interval, hours, cost FROM disk_intervals""")
def disk_cost_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    skus = L.disk_skus(*disk_prices(spark, sf_dir), carry=("created",))
    return E.disk_cost_intervals(skus, A.AS_OF)


_CELLS = [f"{k}_{i}" for i in ("uptime", "last_day", "hourly") for k in ("vm", "disk", "total")]
_BURN_SQL = "SELECT project_id, vm_count, " + ", ".join(f"round({c}, 4) AS {c}" for c in _CELLS) + " FROM burn"


@query("project_burn", _BURN_SQL)
def project_burn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(budget.burn_rates(inputs(spark, sf_dir, billing=False), A.AS_OF), *_CELLS, digits=4)


@query("burn_projection", """SELECT project_id, vm_count, CAST(h.hours AS INTEGER) AS horizon_hours, round(h.hours * vm_hourly, 4) AS vm_cost,
  round(h.hours * disk_hourly, 4) AS disk_cost, round(h.hours * total_hourly, 4) AS total_cost
  FROM burn, (VALUES (6), (12), (24)) AS h(hours) WHERE total_uptime + total_last_day + total_hourly > 0""")
def burn_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    burn = E.is_spending(budget.burn_rates(inputs(spark, sf_dir, billing=False), A.AS_OF))
    return rounded(E.burn_projection(burn), "vm_cost", "disk_cost", "total_cost", digits=4)


@query("is_spending", """SELECT project_id, vm_count, round(total_hourly, 4) AS total_hourly FROM burn
  WHERE total_uptime + total_last_day + total_hourly > 0""")
def is_spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    burn = E.is_spending(budget.burn_rates(inputs(spark, sf_dir, billing=False), A.AS_OF))
    return rounded(burn.select("project_id", "vm_count", "total_hourly"), "total_hourly", digits=4)


@query("burn_log", """SELECT project_id, printf('per hour: machines $%f, disks $%f, together $%f',
  round(vm_hourly, 4), round(disk_hourly, 4), round(total_hourly, 4)) AS line FROM burn
  WHERE total_uptime + total_last_day + total_hourly > 0""")
def burn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.burn_log(rounded(budget.burn_rates(inputs(spark, sf_dir, billing=False), A.AS_OF), *_CELLS, digits=4))


_RATES_SQL = " UNION ALL ".join(
    f"""SELECT project_id, {n} AS line_no, printf('{title}: machines $%f, disks $%f, together $%f', round(vm_{i}, 4), round(disk_{i}, 4),
  round(total_{i}, 4)) AS line FROM burn WHERE total_uptime + total_last_day + total_hourly > 0"""
    for n, (title, i) in enumerate((("since start", "uptime"), ("last day", "last_day"), ("per hour", "hourly"))))
_AHEAD_SQL = """SELECT project_id, h.line_no, printf('next %d hours with %d running machines: machines $%f, disks $%f, together $%f',
  h.hours, vm_count, h.hours * round(vm_hourly, 4), h.hours * round(disk_hourly, 4), h.hours * round(total_hourly, 4)) AS line
  FROM burn, (VALUES (3, 6), (4, 12), (5, 24)) AS h(line_no, hours) WHERE total_uptime + total_last_day + total_hourly > 0"""


@query("burn_report", f"{_RATES_SQL} UNION ALL {_AHEAD_SQL}")
def burn_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.burn_report(rounded(budget.burn_rates(inputs(spark, sf_dir, billing=False), A.AS_OF), *_CELLS, digits=4))
