"""Queries for sources, sinks and scalar keys and price tables (2.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions import keys as KEYS
from tallyforge.operators import billing as B
from tallyforge.operators import prices as P
from tallyforge.plans.price_tables import all_prices, build_price_tables
from tallyforge.session import scratch_path
from tallyforge.sources import alerts, exports, inventory, mappings, sinks, state
from tallyforge.workload import adapters as A
from tallyforge.workload.landing import billing_export, sku_export, vm_pages
from tallyforge.workload.oracle_base import ts
from tallyforge.workload.registry import query

# --- 2.1 ------------------------------------------------------------------------


@query("load_mapping", """SELECT 'key-' || CAST(p_partkey AS VARCHAR) AS machine_key, p_name AS cpu,
  CAST(p_size AS BIGINT) AS cpus_per_core, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS ram FROM part""")
def load_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "mapping-csv")
    spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.concat(F.lit("key-"), F.col("p_partkey")), "p_name", "p_size", F.when(F.col("p_partkey") % 5 > 0, F.col("p_type"))
    ).write.option("header", False).csv(path)
    return mappings.load_mapping(spark, path, schemas.CPU_MAPPING)


@query("scan_sku_export", """SELECT sku_id, description, service, pricing_unit,
  CASE WHEN has_regions THEN region_1 END AS first_region, CASE WHEN has_tiers THEN tier_1 END AS first_usd FROM sku_flat""")
def scan_sku_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sku-export")
    A.sku_export(spark, sf_dir).write.parquet(path)
    return exports.scan_sku_export(spark, path).select(
        F.col("sku.id").alias("sku_id"), F.col("sku.description").alias("description"),
        F.col("service.description").alias("service"), "pricing_unit",
        F.get("geo_taxonomy.regions", F.lit(0)).alias("first_region"),
        F.get("billing_account_price.tiered_rates.usd_amount", F.lit(0)).alias("first_usd"))


@query("scan_billing_export", f"""SELECT project_id, sku_id, {ts('usage_start_time')}, {ts('export_time')},
  CAST(cost AS DOUBLE) AS cost FROM seen_billing""")
def scan_billing_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = exports.scan_billing_export(billing_export(spark, sf_dir), A.AS_OF)
    return seen.select(F.col("project.id").alias("project_id"), F.col("sku.id").alias("sku_id"),
                       "usage_start_time", "export_time", "cost")


_ACCEL_SQL = """array_to_string(list_filter([CAST(accel_1_count AS VARCHAR) || ':' || zone || ':' || accel_1,
  CAST(accel_2_count AS VARCHAR) || ':' || zone || ':' || accel_2], lambda x: x IS NOT NULL), ',')"""


@query("flatten_vm_inventory", f"""SELECT project_id, {ts('inventory_time')}, vm_id, name, zone, status, machine_type, license,
  {ts('created')}, {ts('started')}, {ts('last_stop')}, first_disk_size, first_disk_kind, preemptible,
  {_ACCEL_SQL} AS accel, CAST(CASE WHEN accel_1 IS NULL THEN 0 ELSE 1 END + CASE WHEN accel_2 IS NULL THEN 0 ELSE 1 END
  AS INTEGER) AS num_gpu FROM snapshots_flat""")
def flatten_vm_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda a: F.concat_ws(":", a["count"].cast("string"), a["zone"], a["type"])
    vms = inventory.flatten_vm_inventory(vm_pages(spark, sf_dir))
    return vms.withColumn("accel", F.array_join(F.transform("accel", entry), ","))


@query("machine_type_dim", """SELECT DISTINCT zone, machine_type, cpus, CAST(memory_mb AS INTEGER) AS memory_mb
  FROM snapshots_flat""")
def machine_type_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.machine_type_dim(A.machine_type_records(spark, sf_dir))


@query("flatten_disk_inventory", f"""SELECT project_id, disk_id, zone, name, {ts('created')}, size_gb, is_regional, disk_region,
  type FROM disks_flat""")
def flatten_disk_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.flatten_disk_inventory(A.disk_pages(spark, sf_dir))


@query("decode_budget_alerts", f"""SELECT {ts('event_time')}, message_id, project_id, {ts('interval_start')}, cost, budget
  FROM alerts_flat""")
def decode_budget_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.decode_budget_alerts(A.encoded_alerts(A.budget_alerts(spark, sf_dir)))


def _spoiled(rows: DataFrame, column: str, key: str) -> DataFrame:
    """Every 11th document cut short, every 13th replaced by other text."""
    k = F.col(key)
    cut = F.substring(column, 1, 20)
    return rows.withColumn(column, F.when(k % 11 == 0, cut).when(k % 13 == 0, F.lit("e30=")).otherwise(F.col(column)))


@query("decode_budget_alerts_lenient", f"""SELECT {ts('event_time')}, message_id, project_id, {ts('interval_start')}, cost, budget
  FROM alerts_flat WHERE message_id % 11 <> 0 AND message_id % 13 <> 0""")
def decode_budget_alerts_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good messages among malformed ones."""
    return alerts.decode_budget_alerts(_spoiled(A.encoded_alerts(A.budget_alerts(spark, sf_dir)), "data", "message_id"))


@query("rejected_budget_alerts", """SELECT message_id FROM alerts_flat WHERE message_id % 11 = 0 OR message_id % 13 = 0""")
def rejected_budget_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.rejected_budget_alerts(_spoiled(A.encoded_alerts(A.budget_alerts(spark, sf_dir)), "data", "message_id")).select("message_id")


def _disk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("raw_json", '"id":"disk-([0-9]+)"', 1).cast("bigint")
    return _spoiled(A.disk_pages(spark, sf_dir).withColumn("page", number), "raw_json", "page")


@query("flatten_disk_inventory_lenient", """SELECT project_id, disk_id, size_gb FROM disks_flat
  WHERE CAST(substr(disk_id, 6) AS BIGINT) % 11 <> 0 AND CAST(substr(disk_id, 6) AS BIGINT) % 13 <> 0""")
def flatten_disk_inventory_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disks of good pages among malformed ones."""
    return inventory.flatten_disk_inventory(_disk_pages(spark, sf_dir)).select("project_id", "disk_id", "size_gb")


@query("rejected_pages", """SELECT project_id, CAST(substr(disk_id, 6) AS BIGINT) AS page FROM disks_flat
  WHERE CAST(substr(disk_id, 6) AS BIGINT) % 11 = 0 OR CAST(substr(disk_id, 6) AS BIGINT) % 13 = 0""")
def rejected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.rejected_pages(_disk_pages(spark, sf_dir), schemas.DISK_PAGE).select("project_id", "page")


@query("write_price_table", "SELECT * FROM p_cpu")
def write_price_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.write_price_table(P.pricing(sku_export(spark, sf_dir), "cpu"), scratch_path(spark, "cpu-pricing"))


def _budget_state(spark: SparkSession, name: str, schema) -> state.StateTable:
    return state.StateTable(scratch_path(spark, name), schema, ("project_id", "interval_start"), "year(interval_start)")


@query("save_state", f"""SELECT project_id, {ts('interval_start')}, cost + CASE WHEN CAST(substr(project_id, 6) AS INT) % 2 = 0
  THEN 1 ELSE 0 END AS cost, budget, {ts('event_time')}, message_id FROM interval_cost
  WHERE NOT (CAST(substr(project_id, 6) AS INT) % 2 = 0 AND month(interval_start) = 12)""")
def save_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two saves: all rows, then those of the even projects again, a little dearer, without their Decembers."""
    rows = B.interval_costs(A.budget_alerts(spark, sf_dir))
    table = _budget_state(spark, "budget-state", rows.schema)
    even = F.substring("project_id", 6, 10).cast("int") % 2 == 0
    state.save_state(rows, table)
    state.save_state(rows.where(even).withColumn("cost", F.col("cost") + 1), table, F.month("interval_start") == 12)
    return state.load_state(spark, table)


@query("load_state", f"""SELECT project_id, strftime(interval_start, '%Y-%m') AS interval_start, cost,
  CASE WHEN CAST(substr(project_id, 6) AS INT) % 2 = 0 THEN CAST(1000 AS DOUBLE) END AS budget FROM interval_cost""")
def load_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents kept per project: those of even projects are new, those of odd ones bare maps of the oldest kind."""
    rows = B.interval_costs(A.budget_alerts(spark, sf_dir))
    pairs = F.collect_list(F.struct(F.date_format("interval_start", "yyyy-MM"), "cost"))
    amounts = rows.groupBy("project_id").agg(F.map_from_entries(pairs).alias("amounts"))
    new = F.to_json(F.struct(F.lit(1000.0).alias("budget"), F.create_map(F.lit("1"), F.lit("07")).alias("messages"), "amounts"))
    even = F.substring("project_id", 6, 10).cast("int") % 2 == 0
    docs = amounts.select("project_id", F.when(even, new).otherwise(F.to_json("amounts")).alias("doc"))
    table = state.StateTable(scratch_path(spark, "budget-documents"), docs.schema, ("project_id",), "'all'")
    state.save_state(docs, table)
    return state.budget_amounts(state.load_state(spark, table))


@query("build_price_tables", " UNION ALL ".join(
    f"SELECT '{n}' AS price_table, {k} AS price_key, sku_id, max_usd, min_usd, pricing_unit FROM p_{n}" for n, k in (
        ("cpu", "cpu"), ("ram", "cpu"), ("gpu", "gpu"), ("pd", "pd"), ("cpu_lic", "lic_key"), ("gpu_lic", "lic_key"),
        ("ram_lic", "lic_key"), ("ip", "ip_key"))))
def build_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_prices(build_price_tables(sku_export(spark, sf_dir)))


# --- 2.2 ------------------------------------------------------------------------

for _name in P.TABLES:
    query(f"{_name}_pricing", f"SELECT * FROM p_{_name}")(
        lambda spark, sf_dir, name=_name: P.pricing(sku_export(spark, sf_dir), name))

# --- 2.3 ------------------------------------------------------------------------


def _scalar(name: str, table, inputs: list[str], column, sql: str, source: str) -> None:
    """One scalar over a whole table, with how often each input occurs."""
    cols = ", ".join(inputs)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        counted = table(spark, sf_dir).groupBy(*inputs).agg(F.count("*").alias("n"))
        return counted.select(*inputs, column().alias(name), "n")

    out = ", ".join(ts(c) if c in ("started", "inventory_time", "o_orderdate", "event_time") else c for c in inputs)
    query(name, f"SELECT {out}, {sql} AS {name}, n FROM (SELECT {cols}, count(*) AS n FROM {source} GROUP BY ALL)")(run)


_scalar("machine_key", A.vm_snapshots, ["machine_type"], lambda: KEYS.machine_key("machine_type"),
        "regexp_extract(machine_type, '^[^-]*-[^-]*')", "snapshots_flat")
_scalar("machine_class", A.vm_snapshots, ["machine_type"], lambda: KEYS.machine_class("machine_type"),
        "split_part(machine_type, '-', 1)", "snapshots_flat")
_scalar("region_of_zone", A.vm_snapshots, ["zone"], lambda: KEYS.region_of_zone("zone"),
        "left(zone, length(zone) - 2)", "snapshots_flat")
_scalar("memory_gb", A.vm_snapshots, ["memory_mb"], lambda: KEYS.memory_gb("memory_mb"), "memory_mb / 1024.0",
        "(SELECT CAST(memory_mb AS INTEGER) AS memory_mb FROM snapshots_flat)")
_scalar("special_class", A.vm_snapshots, ["machine_type"], lambda: KEYS.special_class("machine_type"),
        "CASE machine_type WHEN 'f1-micro' THEN 'f1-micro' WHEN 'g1-small' THEN 'g1-small' END", "snapshots_flat")
_scalar("hour_floor", A.vm_snapshots, ["inventory_time"], lambda: KEYS.hour_floor("inventory_time"),
        "strftime(inventory_time, '%Y-%m-%d %H:00:00')", "snapshots_flat")
_scalar("month_floor", A.vm_snapshots, ["started"], lambda: KEYS.month_floor("started"),
        "strftime(started, '%Y-%m-01 00:00:00')", "snapshots_flat")


@query("disk_region", """SELECT disk_id, zone, is_regional, CASE WHEN is_regional THEN disk_region
  ELSE left(zone, length(zone) - 2) END AS region FROM disks_flat""")
def disk_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.disk_inventory(spark, sf_dir).select(
        "disk_id", "zone", "is_regional", KEYS.disk_region("is_regional", "disk_region", "zone").alias("region"))


@query("num_gpu", f"""SELECT vm_id, {ts('inventory_time')}, CAST(CASE WHEN accel_2 IS NOT NULL THEN 2
  WHEN accel_1 IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS num_gpu FROM snapshots_flat""")
def num_gpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vm_snapshots(spark, sf_dir).select("vm_id", "inventory_time", KEYS.num_gpu("accel").alias("num_gpu"))


@query("last_path_segment", "SELECT page_id, url, regexp_extract(url, '[^/]*$') AS segment FROM pages")
def last_path_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", KEYS.last_path_segment("url").alias("segment"))


@query("parse_rfc3339", f"""SELECT message_id, strftime(event_time, '%Y-%m-%dT%H:%M:%S.000+0000') AS text,
  {ts('event_time', 'parsed')}, {ts('event_time + INTERVAL 7 HOUR', 'parsed_west')} FROM alerts_flat""")
def parse_rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda zone: F.date_format("event_time", f"yyyy-MM-dd'T'HH:mm:ss.SSS'{zone}'")
    return A.budget_alerts(spark, sf_dir).select(
        "message_id", text("+0000").alias("text"), KEYS.parse_rfc3339(text("+0000")).alias("parsed"),
        KEYS.parse_rfc3339(text("-07:00")).alias("parsed_west"))


@query("iso_week", f"""SELECT {ts('o_orderdate')}, CAST(isoyear(o_orderdate) AS INTEGER) AS iso_year,
  CAST(weekofyear(o_orderdate) AS INTEGER) AS iso_week, count(*) AS n FROM orders GROUP BY ALL""")
def iso_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy("o_orderdate", KEYS.iso_year("o_orderdate").alias("iso_year"),
                          KEYS.iso_week("o_orderdate").alias("iso_week")).agg(F.count("*").alias("n"))
