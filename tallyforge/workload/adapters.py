"""Domain tables derived from the given test tables.

Each table is written once, as SQL text with a dialect for the few functions
that are spelled differently, and used on both sides: Spark builds its nested
domain tables on top of the flat columns, and the oracle queries read the flat
columns directly. All are projections of whole tables (plus one join to the
25-row nation table); nothing is sampled.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import constants as C
from tallyforge import schemas
from tallyforge.functions.keys import parse_rfc3339
from tallyforge.session import spread

AS_OF = datetime(2024, 1, 20, 12, 34, 56)
AS_OF_SQL = "TIMESTAMP '2024-01-20 12:34:56'"
ORIGIN_SECONDS = 1701388800  # 2023-12-01
REGIONS = ("us-central1", "us-east1", "europe-west1", "asia-east1", "us-west1")

_CPU = C.csv_rows(C.CPU_MAPPING_CSV)
CPU_KEYS = [r[0] for r in _CPU]
CPU_NAMES = sorted({r[1] for r in _CPU})
RAM_NAMES = sorted({r[3] for r in _CPU if r[3]})
GPU_KEYS = [r[0] for r in C.csv_rows(C.GPU_MAPPING_CSV)]
GPU_NAMES = [r[1] for r in C.csv_rows(C.GPU_MAPPING_CSV)]
PD_KEYS = [r[0] for r in C.csv_rows(C.PD_MAPPING_CSV)]
PD_NAMES = [r[1] for r in C.csv_rows(C.PD_MAPPING_CSV)]
LICENSE_KEYS = [r[0] for r in C.csv_rows(C.LICENSE_MAPPING_CSV)]
LICENSE_NAMES = sorted({r[1] for r in C.csv_rows(C.LICENSE_MAPPING_CSV)})
FIXED_SIZE_KEYS = ("e2-medium", "e2-micro", "e2-small", "f1-micro", "g1-small")


class Spark:
    """Spellings of the Spark side; tables are placeholders filled by ``spark.sql``."""

    @staticmethod
    def table(name: str) -> str:
        return "{" + name + "}"

    @staticmethod
    def div(a: str, b: int) -> str:
        return f"(({a}) div {b})"

    @staticmethod
    def pick(values: list[str] | tuple[str, ...], index: str) -> str:
        items = ", ".join(f"'{v}'" for v in values)
        return f"element_at(array({items}), CAST(({index}) % {len(values)} AS INT) + 1)"

    @staticmethod
    def seconds(ts: str) -> str:
        return f"unix_seconds(CAST({ts} AS TIMESTAMP))"

    @staticmethod
    def instant(seconds: str) -> str:
        return f"timestamp_seconds({seconds})"

    @staticmethod
    def month(ts: str) -> str:
        return f"date_format({ts}, 'yyyyMM')"


class Duck(Spark):
    """Spellings of the oracle side."""

    @staticmethod
    def table(name: str) -> str:
        return name

    @staticmethod
    def div(a: str, b: int) -> str:
        return f"(({a}) // {b})"

    @staticmethod
    def pick(values: list[str] | tuple[str, ...], index: str) -> str:
        items = ", ".join(f"'{v}'" for v in values)
        return f"([{items}])[(({index}) % {len(values)}) + 1]"

    @staticmethod
    def seconds(ts: str) -> str:
        return f"CAST(floor(epoch({ts})) AS BIGINT)"

    @staticmethod
    def instant(seconds: str) -> str:
        return f"make_timestamp(CAST({seconds} AS BIGINT) * 1000000)"

    @staticmethod
    def month(ts: str) -> str:
        return f"strftime({ts}, '%Y%m')"


Dialect = type[Spark]


def sku_flat(d: Dialect) -> str:
    """Price export: the description template goes by part key, the price by size."""
    k, fam = "(p_partkey % 12)", d.div("p_partkey", 12)
    region = d.pick(REGIONS, f"{fam} + {d.div(fam, 15)}")
    other = d.pick(REGIONS, f"{fam} + {d.div(fam, 15)} + 2")
    lic = d.pick(LICENSE_NAMES, fam)
    low = "(1 + p_size % 4)"
    return f"""
SELECT 'SKU-' || CAST(p_partkey AS STRING) AS sku_id,
  CASE WHEN p_type = 'ECONOMY' AND p_size % 7 = 0 THEN 'Commitment v1: '
       WHEN p_type = 'ECONOMY' AND p_size % 7 = 1 THEN 'Sole Tenancy '
       WHEN p_type = 'ECONOMY' AND p_size % 7 = 2 THEN 'Reserved ' ELSE '' END ||
  CASE {k}
    WHEN 0 THEN {d.pick(CPU_NAMES, fam)} || CASE WHEN p_size % 23 = 0 THEN '' ELSE ' running in ' || {region} END
    WHEN 1 THEN 'Preemptible ' || {d.pick(CPU_NAMES, fam)} || ' running in ' || {region}
    WHEN 2 THEN {d.pick(RAM_NAMES, fam)} || ' running in ' || {region}
    WHEN 3 THEN 'Preemptible ' || {d.pick(RAM_NAMES, fam)} || ' running in ' || {region}
    WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN 'Preemptible ' ELSE '' END ||
      CASE WHEN p_size % 19 = 0 THEN 'GPU attached' ELSE {d.pick(GPU_NAMES, fam)} || ' GPU running' END || ' in ' || {region}
    WHEN 5 THEN {d.pick(PD_NAMES, fam)} || ' in ' || {region}
    WHEN 6 THEN 'Regional ' || {d.pick(PD_NAMES, fam)} || ' in ' || {region}
    WHEN 7 THEN {d.pick(("External", "Static", "Internal"), fam)} || ' IP Charge on a ' ||
      CASE WHEN p_size % 2 = 0 THEN 'Standard VM' ELSE 'Spot Preemptible VM' END
    WHEN 8 THEN 'Licensing Fee for ' || {lic} || ' (CPU cost)'
    WHEN 9 THEN 'Licensing Fee for ' || {lic} || CASE p_size % 6
      WHEN 0 THEN ' on VM with up to ' || CAST({low} * 2 AS STRING) || ' VCPU'
      WHEN 1 THEN ' on VM with ' || CAST({low} AS STRING) || ' to ' || CAST({low} * 4 AS STRING) || ' VCPU'
      WHEN 2 THEN ' on VM with ' || CAST({low} * 2 AS STRING) || ' or more VCPU'
      WHEN 3 THEN ' on VM with ' || CAST({low} AS STRING) || ' VCPU'
      WHEN 4 THEN ' on f1-micro' ELSE ' on g1-small' END
    WHEN 10 THEN 'Licensing Fee for ' || {lic} || CASE p_size % 4
      WHEN 0 THEN ' (GPU cost)'
      WHEN 1 THEN ' on VM with up to ' || CAST({low} AS STRING) || ' GPU'
      WHEN 2 THEN ' on VM with ' || CAST({low} AS STRING) || ' to ' || CAST({low} * 2 AS STRING) || ' GPU'
      ELSE ' on VM with ' || CAST({low} AS STRING) || ' or more GPU' END
    ELSE 'Licensing Fee for ' || {lic} || ' (RAM cost)' END AS description,
  CASE WHEN p_brand = 'Brand#13' THEN 'Cloud Storage' ELSE 'Compute Engine' END AS service,
  {region} AS region_1, {other} AS region_2, p_partkey % 197 <> 7 AS has_regions,
  p_retailprice * p_size / 100000.0 AS tier_1,
  CASE WHEN p_size % 3 = 0 THEN p_retailprice * p_size / 200000.0 END AS tier_2,
  p_partkey % 199 <> 5 AS has_tiers,
  CASE WHEN p_partkey % 211 = 3 THEN 'COUNT' WHEN {k} IN (2, 3, 11) THEN 'GIBIBYTE_HOUR'
       WHEN {k} IN (5, 6) THEN 'GIBIBYTE_MONTH' ELSE 'HOUR' END AS pricing_unit
FROM {d.table('part')}"""


def billing_flat(d: Dialect) -> str:
    """Charge export of the ten days before AS_OF: several SKUs, slots and exports per project."""
    day = d.div(f"{d.seconds('l_shipdate')}", 86400)
    slot_end = f"({d.seconds(AS_OF_SQL)} - 2096 - ({day} * 5 + l_linenumber * 3 + l_orderkey) % 240 * 3600)"
    return f"""
SELECT project_id, project_name, service, sku_id, sku_description, cost, usage_amount, usage_unit,
  {d.month(d.instant('t'))} AS invoice_month, {d.instant('t')} AS usage_start_time,
  {d.instant('t + 3600')} AS usage_end_time, {d.instant('t + 3600 + lag_h * 3600')} AS export_time,
  CAST({d.instant('t + 3600 + lag_h * 3600')} AS DATE) AS export_date
FROM (SELECT 'proj-' || CAST(l_suppkey % 10 AS STRING) AS project_id,
  'Project ' || CAST(l_suppkey % 10 AS STRING) AS project_name,
  {d.pick(("Compute Engine", "Cloud Storage", "Networking"), "l_partkey % 1000")} AS service,
  'SKU-' || CAST(l_partkey % 1000 AS STRING) AS sku_id,
  'Family ' || CAST(l_partkey % 1000 % 40 AS STRING) || CASE l_partkey % 1000 % 7
    WHEN 0 THEN ' Download Worldwide' WHEN 1 THEN ' Inter Region Egress' ELSE ' Instance Core' END AS sku_description,
  CASE WHEN l_orderkey % 50 = 0 THEN 0.00001 ELSE l_extendedprice * (1 - l_discount) END AS cost,
  l_quantity AS usage_amount,
  CASE WHEN l_partkey % 1000 % 7 < 2 THEN 'gibibyte' ELSE 'hour' END AS usage_unit,
  CAST(l_quantity AS BIGINT) AS lag_h, {slot_end} - 3600 AS t
FROM {d.table('lineitem')}) AS b"""


def snapshots_flat(d: Dialect) -> str:
    """VM inventory polls: each machine runs and rests in a fixed rhythm of its own.

    Machine n is polled at the (20-minute) times of its events. Every fifth
    never stops; the others run the first hours of each period.
    """
    origin = f"({ORIGIN_SECONDS} + vm_no % 97 * 900)"
    cpus = f"CASE {d.div('vm_no', 3)} % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END"
    fixed = ", ".join(f"'{k}'" for k in FIXED_SIZE_KEYS)
    return f"""
SELECT 'proj-' || CAST(vm_no % 10 AS STRING) AS project_id, 'vm-' || CAST(vm_no AS STRING) AS vm_id,
  'machine-' || CAST(vm_no AS STRING) AS name,
  {d.pick(REGIONS, d.div('vm_no', 10))} || {d.pick(("-a", "-b", "-c"), d.div('vm_no', 7))} AS zone,
  CASE WHEN up THEN 'RUNNING' ELSE 'TERMINATED' END AS status,
  CASE WHEN type_key IN ({fixed}) THEN type_key ELSE type_key || '-' || CAST(cpus AS STRING) END AS machine_type,
  CASE WHEN vm_no % 53 = 3 THEN NULL ELSE {d.pick(LICENSE_KEYS, 'vm_no')} END AS license,
  {d.instant('tick')} AS inventory_time, {d.instant('origin - 86400')} AS created,
  {d.instant('begun')} AS started,
  CASE WHEN up AND cycle = 0 THEN NULL WHEN up THEN {d.instant('begun - period + run')}
       ELSE {d.instant('begun + run')} END AS last_stop,
  CAST(10 + vm_no % 90 AS STRING) AS first_disk_size, 'compute#attachedDisk' AS first_disk_kind,
  vm_no % 4 = 1 AS preemptible, CAST(cpus AS DOUBLE) AS cpus,
  CASE type_key WHEN 'f1-micro' THEN 614 WHEN 'g1-small' THEN 1740 ELSE cpus * 3840 END AS memory_mb,
  CASE WHEN vm_no % 3 = 0 THEN {d.pick(GPU_KEYS, d.div('vm_no', 3))} END AS accel_1,
  CASE WHEN vm_no % 3 = 0 THEN 1 + vm_no % 4 END AS accel_1_count,
  CASE WHEN vm_no % 9 = 0 THEN {d.pick(GPU_KEYS, d.div('vm_no', 9))} END AS accel_2,
  CASE WHEN vm_no % 9 = 0 THEN 2 END AS accel_2_count, vm_no
FROM (SELECT *, origin + cycle * period AS begun, tick - origin - cycle * period < run AS up
  FROM (SELECT *, CASE WHEN steady THEN 0 ELSE CAST(floor((tick - origin) / period) AS BIGINT) END AS cycle
    FROM (SELECT vm_no, tick - tick % 1200 AS tick, {origin} AS origin, {d.div('vm_no', 11)} % 5 = 4 AS steady,
        (30 + vm_no % 7 * 24) * 3600 AS period,
        CASE WHEN {d.div('vm_no', 11)} % 5 = 4 THEN 100000000 ELSE (6 + vm_no % 23) * 3600 END AS run,
        {d.pick(CPU_KEYS, 'vm_no')} AS type_key,
        CASE WHEN {d.pick(CPU_KEYS, 'vm_no')} IN ({fixed}) THEN 2 ELSE {cpus} END AS cpus
      FROM (SELECT user_id * 8 + event_id % 8 AS vm_no, {d.seconds('ts')} AS tick FROM {d.table('events')}) AS e
    ) AS f) AS g) AS h"""


def disks_flat(d: Dialect) -> str:
    """Disk inventory; the region comes from the owner's nation."""
    region = d.pick(REGIONS, "n_regionkey")
    created = "(1698796800 + c_custkey * 7 % 1932 * 3600 + c_custkey % 60 * 60)"
    return f"""
SELECT 'proj-' || CAST({d.div('c_custkey', 3)} % 10 AS STRING) AS project_id,
  'disk-' || CAST(c_custkey AS STRING) AS disk_id, {region} || '-a' AS zone,
  'volume-' || CAST(c_custkey AS STRING) AS name, {d.instant(created)} AS created,
  CAST(10 + c_custkey % 500 AS INT) AS size_gb, c_custkey % 5 = 0 AS is_regional,
  CASE WHEN c_custkey % 5 = 0 THEN {region} END AS disk_region, {d.pick(PD_KEYS, 'c_custkey')} AS type
FROM {d.table('customer')} JOIN {d.table('nation')} ON c_nationkey = n_nationkey"""


def alerts_flat(d: Dialect) -> str:
    """Budget messages; the budget of a project changes every year."""
    start = "date_trunc('month', o_orderdate)"
    return f"""
SELECT 'proj-' || CAST(o_custkey % 10 AS STRING) AS project_id, {d.instant(d.seconds(start))} AS interval_start,
  o_totalprice AS cost,
  CAST(18000000 + 1500000 * (o_custkey % 10) + 100000 * (year(o_orderdate) % 7) AS DOUBLE) AS budget,
  {d.instant(d.seconds('o_orderdate') + ' + o_orderkey % 86400')} AS event_time, o_orderkey AS message_id
FROM {d.table('orders')}"""


def settings_flat(d: Dialect) -> str:
    """Per-project flags: serves an app, has compute enabled."""
    return f"""
SELECT DISTINCT 'proj-' || CAST(s_suppkey % 10 AS STRING) AS project_id, s_suppkey % 10 % 3 = 0 AS has_app,
  s_suppkey % 10 <> 9 AS compute_enabled
FROM {d.table('supplier')}"""


FLAT = {
    "sku_flat": (sku_flat, ("part",)),
    "billing_flat": (billing_flat, ("lineitem",)),
    "snapshots_flat": (snapshots_flat, ("events",)),
    "disks_flat": (disks_flat, ("customer", "nation")),
    "alerts_flat": (alerts_flat, ("orders",)),
    "settings_flat": (settings_flat, ("supplier",)),
}


def of_some(table: str, condition: str) -> Dialect:
    """The oracle side with only those rows of ``table`` that meet ``condition``."""
    class Some(Duck):
        @staticmethod
        def table(name: str) -> str:
            return f"(SELECT * FROM {name} WHERE {condition})" if name == table else name

    return Some


def flat(spark: SparkSession, sf_dir: str, name: str, **tables: DataFrame) -> DataFrame:
    """The relation ``name``; ``tables`` stand in for given tables of those names."""
    text, needed = FLAT[name]
    read = {t: tables[t] if t in tables else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in needed}
    return spark.sql(text(Spark), **read)


# --- domain tables in their nested shapes ---------------------------------------

def sku_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    tiers = F.filter(F.array("tier_1", "tier_2"), lambda t: t.isNotNull())
    parts = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    return flat(spark, sf_dir, "sku_flat", part=parts).select(
        F.struct(F.col("sku_id").alias("id"), F.col("description")).alias("sku"),
        F.struct(F.col("service").alias("description")).alias("service"),
        F.struct(F.when(F.col("has_regions"), F.array("region_1", "region_2")).otherwise(none).alias("regions"))
         .alias("geo_taxonomy"),
        F.struct(F.when(F.col("has_tiers"), F.transform(tiers, lambda t: F.struct(t.alias("usd_amount"))))
                 .otherwise(F.array().cast("array<struct<usd_amount:double>>")).alias("tiered_rates"))
         .alias("billing_account_price"),
        "pricing_unit",
    )


def nested_billing(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.struct(F.col("project_id").alias("id"), F.col("project_name").alias("name")).alias("project"),
        F.struct(F.col("service").alias("description")).alias("service"),
        F.struct(F.col("sku_id").alias("id"), F.col("sku_description").alias("description")).alias("sku"),
        F.col("cost").cast("double").alias("cost"),
        F.struct(F.col("usage_amount").alias("amount"), F.col("usage_unit").alias("unit")).alias("usage"),
        F.struct(F.col("invoice_month").alias("month")).alias("invoice"),
        "usage_start_time", "usage_end_time", "export_time", "export_date",
    )


def billing_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_billing(flat(spark, sf_dir, "billing_flat"))


def vm_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda i: F.struct(
        F.col(f"accel_{i}_count").cast("int").alias("count"), F.col("zone").alias("zone"),
        F.col(f"accel_{i}").alias("type"))
    accel = F.filter(F.array(entry(1), entry(2)), lambda a: a["type"].isNotNull())
    return flat(spark, sf_dir, "snapshots_flat").select(
        "project_id", "vm_id", "name", "zone", "status", "machine_type", "license", "inventory_time", "created",
        "started", "last_stop", "first_disk_size", "first_disk_kind", "preemptible", accel.alias("accel"), "cpus",
        F.col("memory_mb").cast("int").alias("memory_mb"))


def disk_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "disks_flat")


def budget_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "alerts_flat")


def project_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "settings_flat")


def mappings(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: schemas.shipped_mapping(spark, name) for name in schemas.MAPPINGS}


# --- raw documents, for the operators that decode them ---------------------------

def _rfc3339(ts: str, offset_colon: bool = True):
    zone = "'+00:00'" if offset_colon else "'+0000'"
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS" + zone)


_API = "https://compute.example.com/v1/projects/p"


def _page(zone_items):
    """A page holding the given zone and one empty zone."""
    items = F.map_from_arrays(
        F.array(F.concat(F.lit("zones/"), F.col("zone")), F.lit("zones/nowhere-x")),
        F.array(zone_items, zone_items.withField("warning", F.struct(F.lit(C.EMPTY_PAGE_CODE).alias("code")))))
    return F.to_json(F.struct(items.alias("items"))).alias("raw_json")


def _instance() -> Column:
    """A machine as the API describes it; a second disk, if any, says nothing about the license."""
    url = lambda kind, name: F.concat(F.lit(f"{_API}/zones/"), F.col("zone"), F.lit(f"/{kind}/"), name)
    gpus = F.transform("accel", lambda a: F.struct(
        url("acceleratorTypes", a["type"]).alias("acceleratorType"), a["count"].alias("acceleratorCount")))
    licenses = F.when(F.col("license").isNotNull(), F.array(F.concat(F.lit(f"{_API}/global/licenses/"), F.col("license"))))
    disk = F.struct(F.col("first_disk_size").alias("diskSizeGb"), F.col("first_disk_kind").alias("kind"),
                    licenses.alias("licenses"))
    second = F.struct(F.lit("7").alias("diskSizeGb"), F.lit("compute#second").alias("kind"),
                      F.array(F.lit(f"{_API}/global/licenses/of-the-second")).alias("licenses"))
    disks = F.when(F.length("name") % 2 == 0, F.array(disk, second)).otherwise(F.array(disk))
    return F.struct(
        F.col("vm_id").alias("id"), "name", "status", _rfc3339("created").alias("creationTimestamp"),
        _rfc3339("started").alias("lastStartTimestamp"), _rfc3339("last_stop", False).alias("lastStopTimestamp"),
        url("machineTypes", F.col("machine_type")).alias("machineType"), disks.alias("disks"),
        F.struct("preemptible").alias("scheduling"), F.when(F.size("accel") > 0, gpus).alias("guestAccelerators"))


def vm_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw inventory pages, one per snapshot row, with the API's document shape."""
    instance = _instance()
    no_warning = F.lit(None).cast("struct<code:string>")
    page = F.struct(no_warning.alias("warning"), F.array(instance).alias("instances"))
    return vm_snapshots(spark, sf_dir).select("project_id", "inventory_time", _page(page))


def vm_listing(spark: SparkSession, sf_dir: str, machines: DataFrame, pages: int = 8) -> DataFrame:
    """The machines as a listing at AS_OF: a few pages per project, each with many machines in many zones."""
    no_warning = F.lit(None).cast("struct<code:string>")
    by_zone = machines.withColumn("page", F.pmod(F.xxhash64("vm_id"), F.lit(pages))).groupBy("project_id", "page", "zone").agg(
        F.struct(no_warning.alias("warning"), F.collect_list(_instance()).alias("instances")).alias("scope"))
    items = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("zones/"), F.col("zone")), "scope")))
    return by_zone.groupBy("project_id", "page").agg(F.to_json(F.struct(items.alias("items"))).alias("raw_json")).select(
        "project_id", F.lit(AS_OF).cast("timestamp").alias("inventory_time"), "raw_json")


def machine_type_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type descriptions as landed: one per snapshot, so each comes many times."""
    zone = F.concat(F.lit(f"{_API}/zones/"), F.col("zone"))
    return vm_snapshots(spark, sf_dir).select(
        zone.alias("zone"), F.concat(zone, F.lit("/machineTypes/"), "machine_type").alias("name"),
        F.col("cpus").cast("int").alias("guestCpus"), F.col("memory_mb").alias("memoryMb"))


#: Owners whose account is overdrawn have had their disks deleted since.
DISK_STAYS = "c_acctbal >= 0"


def listed_disk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages of the last listing: the disks that are still there."""
    owners = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").where(DISK_STAYS), "c_custkey")
    return disk_pages(spark, sf_dir, flat(spark, sf_dir, "disks_flat", customer=owners))


def disk_pages(spark: SparkSession, sf_dir: str, disks: DataFrame | None = None) -> DataFrame:
    """Raw disk pages, one per disk."""
    region = F.concat(F.lit(f"{_API}/regions/"), "disk_region")
    zone = F.concat(F.lit(f"{_API}/zones/"), "zone")
    disk = F.struct(
        F.col("disk_id").alias("id"), "name", _rfc3339("created").alias("creationTimestamp"),
        F.col("size_gb").cast("string").alias("sizeGb"),
        F.concat(zone, F.lit("/diskTypes/"), "type").alias("type"), region.alias("region"),
        F.when(F.col("is_regional"), F.array(zone, F.concat(zone, F.lit("2")))).alias("replicaZones"))
    no_warning = F.lit(None).cast("struct<code:string>")
    page = F.struct(no_warning.alias("warning"), F.array(disk).alias("disks"))
    return (disk_inventory(spark, sf_dir) if disks is None else disks).select("project_id", _page(page))


def encoded_alerts(alerts: DataFrame) -> DataFrame:
    """Budget messages back in their wire form: base64 JSON next to the event time."""
    body = F.to_json(F.struct(
        F.col("cost").alias("costAmount"), F.col("budget").alias("budgetAmount"),
        F.concat("project_id", F.lit("-budget")).alias("budgetDisplayName"),
        _rfc3339("interval_start").alias("costIntervalStart")))
    return alerts.select("event_time", "message_id", F.base64(F.encode(body, "UTF-8")).alias("data"))
