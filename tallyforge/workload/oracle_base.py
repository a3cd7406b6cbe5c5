"""Named relations the oracle queries are composed of.

The adapters are shared with Spark (they define the input); every operator is
spelled out here independently, in plain SQL.
"""

from __future__ import annotations

import re

from tallyforge import constants as C
from tallyforge.workload import adapters as A

NOW = A.AS_OF_SQL
TEXT_TS = "%Y-%m-%d %H:%M:%S"


def ts(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, '{TEXT_TS}') AS {alias or column.split('.')[-1]}"


def _values(text: str, columns: str) -> str:
    rows = []
    for row in C.csv_rows(text):
        rows.append("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS m({columns})"


# The fragments and patterns of price descriptions, as in constants.py, spelled for this dialect here and in
# the price relations below.
REGULAR = "NOT regexp_matches(description, 'Sole Tenancy|Proxy Instance Charge|Upgrade Premium|Reserved|Commitment')"
COMPUTE = "contains(service, 'Compute')"
PREEMPTIBLE = "contains(description, 'reemptible') AS preemptible"


def _cut(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(description, '{pattern}') THEN regexp_extract(description, '{pattern}', 1) END"


def _num(pattern: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract(description, '{pattern}', 1), '') AS BIGINT)"


_CORE = f"trim(replace(replace({_cut('(.*) in .*')}, 'Preemptible ', ' '), 'running', ''))"


def _folded(keys: str, where: str, source: str) -> str:
    return (f"SELECT {keys}, sku_id, max(usd) AS max_usd, min(usd) AS min_usd, pricing_unit "
            f"FROM {source} WHERE {where} GROUP BY ALL")


def _bounds(unit: str, low: str, high: str, exact: bool) -> str:
    single = f" WHEN description LIKE '% on VM with % {unit}' THEN {_num(f' on VM with ([0-9]+) {unit}')}" if exact else ""
    return f"""CASE WHEN description LIKE '% or more %' THEN {_num(f' on VM with ([0-9]+) or more {unit}')}
       WHEN description LIKE '% on VM with % to %' THEN {_num(f' on VM with ([0-9]+) to [0-9]+ {unit}')}{single} END AS {low},
  CASE WHEN description LIKE '% on VM with up to %' THEN {_num(f' on VM with up to ([0-9]+) {unit}')}
       WHEN description LIKE '% on VM with % to %' THEN {_num(f' on VM with [0-9]+ to ([0-9]+) {unit}')}{single} END AS {high}"""


def _first(match: str, keys: str) -> str:
    """One row per key: dearest, then smallest SKU id; n_matches counts all."""
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n_matches,
  row_number() OVER (PARTITION BY {keys} ORDER BY max_usd DESC NULLS LAST, sku_id, min_usd, pricing_unit) AS rn
  FROM {match}) WHERE rn = 1"""


RELATIONS: dict[str, str] = {
    **{name: build(A.Duck) for name, (build, _) in A.FLAT.items()},
    "cpu_map": _values(C.CPU_MAPPING_CSV, "machine_key, cpu, cpus_per_core, ram").replace(
        "SELECT *", "SELECT machine_key, cpu, CAST(cpus_per_core AS BIGINT) AS cpus_per_core, ram"),
    "gpu_map": _values(C.GPU_MAPPING_CSV, "gpu_key, gpu"),
    "pd_map": _values(C.PD_MAPPING_CSV, "pd_key, pd"),
    "lic_map": _values(C.LICENSE_MAPPING_CSV, "license, vm_license, confidence"),
    # price tables
    "sku_tiers": """SELECT sku_id, description, service, pricing_unit, has_regions, region_1, region_2, t.usd
FROM sku_flat, UNNEST(list_filter([tier_1, tier_2], lambda x: x IS NOT NULL)) AS t(usd) WHERE has_tiers""",
    "sku_rows": """SELECT s.*, r.region FROM sku_tiers AS s, UNNEST([region_1, region_2]) AS r(region) WHERE has_regions""",
    "p_cpu": _folded(f"{_CORE} AS cpu, {PREEMPTIBLE}, region",
                     f"regexp_matches(description, 'Instance|Core') AND {REGULAR} AND NOT contains(description, 'Ram') "
                     f"AND {COMPUTE}", "sku_rows"),
    "p_ram": _folded(f"{_CORE} AS cpu, {PREEMPTIBLE}, region",
                     f"regexp_matches(description, 'Instance|Core|Ram') AND {REGULAR} "
                     f"AND regexp_matches(description, 'Ram|RAM') AND {COMPUTE}", "sku_rows"),
    "p_gpu": _folded(f"'Nvidia ' || {_cut('.*Nvidia (.*) GPU .*')} AS gpu, {PREEMPTIBLE}, region",
                     f"contains(description, 'GPU') AND {REGULAR} AND NOT contains(description, 'Ram') AND {COMPUTE}",
                     "sku_rows"),
    "p_pd": _folded(f"trim(replace({_cut('(.*) PD Capacity.*')} || ' PD Capacity', 'Regional ', '')) AS pd, "
                    "contains(description, 'Regional') AS is_regional, region",
                    "contains(description, 'PD Capacity')", "sku_rows"),
    "p_ip": _folded(f"trim({_cut('(.*) on a .*')}) AS ip_key, {PREEMPTIBLE}",
                    f"contains(description, ' IP ') AND {COMPUTE}", "sku_tiers"),
    "p_gpu_lic": _folded(
        f"""CASE WHEN contains(description, ' on VM with ') THEN trim({_cut('Licensing Fee for (.*) on VM with .*')})
       ELSE trim(replace({_cut('Licensing Fee for (.*)')}, '(GPU cost)', '')) END AS lic_key,
  {_bounds('GPU', 'min_gpu', 'max_gpu', False)}""",
        f"contains(description, 'Licen') AND contains(description, 'GPU') AND {COMPUTE}", "sku_tiers"),
    "p_cpu_lic": _folded(
        f"""CASE WHEN contains(description, ' on g1-small') THEN 'g1-small'
       WHEN contains(description, ' on f1-micro') THEN 'f1-micro' END AS machine_class,
  CASE WHEN contains(description, ' on VM with ') THEN trim({_cut('Licensing Fee for (.*) on VM with .*')})
       WHEN regexp_matches(description, ' on (g1-small|f1-micro)') THEN trim({_cut('Licensing Fee for (.*) on .*')})
       ELSE trim(replace({_cut('Licensing Fee for (.*)')}, '(CPU cost)', '')) END AS lic_key,
  {_bounds('VCPU', 'min_cpu', 'max_cpu', True)}""",
        f"contains(description, 'Licen') AND NOT regexp_matches(description, 'GPU|RAM cost') AND {COMPUTE}",
        "sku_tiers"),
    "p_ram_lic": _folded(f"trim(replace({_cut('Licensing Fee for (.*)')}, '(RAM cost)', '')) AS lic_key",
                         f"contains(description, 'Licen') AND contains(description, 'RAM') AND {COMPUTE}",
                         "sku_tiers"),
    # inventory
    "vms": f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY project_id, vm_id ORDER BY inventory_time DESC) AS rn
  FROM snapshots_flat WHERE inventory_time <= {NOW}) WHERE rn = 1""",
    "vm_keys": """SELECT *, array_to_string(string_split(machine_type, '-')[1:2], '-') AS machine_key,
  regexp_replace(zone, '-[^-]+$', '') AS region,
  CASE WHEN machine_type IN ('f1-micro', 'g1-small') THEN machine_type END AS special_class,
  CASE WHEN accel_1 IS NULL THEN 0 ELSE 1 END + CASE WHEN accel_2 IS NULL THEN 0 ELSE 1 END AS num_gpu,
  memory_mb / 1024.0 AS memory_gb FROM vms""",
    "accels": """SELECT project_id, vm_id, 0 AS entry, accel_1 AS gpu_key, accel_1_count AS gpu_count, region, preemptible
FROM vm_keys WHERE accel_1 IS NOT NULL UNION ALL
SELECT project_id, vm_id, 1, accel_2, accel_2_count, region, preemptible FROM vm_keys WHERE accel_2 IS NOT NULL""",
    "disk_keys": """SELECT *, CASE WHEN is_regional THEN disk_region ELSE regexp_replace(zone, '-[^-]+$', '') END AS region
FROM disks_flat""",
    # lookups: every match, then one price
    "vm_matches": """SELECT v.project_id, v.vm_id, v.machine_key, v.region, v.preemptible, m.cpu, m.ram, m.cpus_per_core,
  c.sku_id AS cpu_sku_id, c.max_usd AS cpu_max_usd, c.pricing_unit AS cpu_pricing_unit,
  r.sku_id AS ram_sku_id, r.max_usd AS ram_max_usd, r.pricing_unit AS ram_pricing_unit
FROM vm_keys AS v JOIN cpu_map AS m ON m.machine_key = v.machine_key
JOIN p_cpu AS c ON c.cpu = m.cpu AND c.region = v.region AND c.preemptible = v.preemptible
LEFT JOIN p_ram AS r ON r.cpu = m.ram
WHERE (r.region = v.region OR r.region IS NULL) AND (r.preemptible = v.preemptible OR r.preemptible IS NULL)""",
    "vm_price": """SELECT * EXCLUDE (rn) FROM (SELECT *, count(*) OVER (PARTITION BY project_id, vm_id) AS n_matches,
  row_number() OVER (PARTITION BY project_id, vm_id ORDER BY cpu_max_usd DESC, cpu_sku_id, ram_max_usd DESC, ram_sku_id)
  AS rn FROM vm_matches) WHERE rn = 1""",
    "gpu_matches": """SELECT a.*, p.sku_id, p.max_usd, p.min_usd, p.pricing_unit FROM accels AS a
JOIN gpu_map AS m ON m.gpu_key = a.gpu_key
JOIN p_gpu AS p ON p.gpu = m.gpu AND p.region = a.region AND p.preemptible = a.preemptible""",
    "gpu_price": _first("gpu_matches", "project_id, vm_id, entry"),
    "pd_matches": """SELECT d.project_id, d.disk_id, d.type AS pd_key, d.region, d.is_regional, d.size_gb, d.created,
  p.sku_id, p.max_usd, p.min_usd, p.pricing_unit FROM disk_keys AS d JOIN pd_map AS m ON m.pd_key = d.type
JOIN p_pd AS p ON p.pd = m.pd AND p.region = d.region AND p.is_regional = d.is_regional""",
    "pd_price": _first("pd_matches", "project_id, disk_id"),
    "cpu_lic_matches": """SELECT v.project_id, v.vm_id, v.license, v.cpus, v.special_class,
  p.sku_id, p.max_usd, p.min_usd, p.pricing_unit FROM vm_keys AS v JOIN lic_map AS m ON m.license = v.license
JOIN p_cpu_lic AS p ON p.lic_key = m.vm_license AND p.machine_class IS NOT DISTINCT FROM v.special_class
WHERE (p.max_cpu IS NULL OR p.max_cpu >= v.cpus) AND (p.min_cpu IS NULL OR p.min_cpu <= v.cpus)""",
    "cpu_lic_price": _first("cpu_lic_matches", "project_id, vm_id"),
    "gpu_lic_matches": """SELECT v.project_id, v.vm_id, v.license, v.num_gpu,
  p.sku_id, p.max_usd, p.min_usd, p.pricing_unit FROM vm_keys AS v JOIN lic_map AS m ON m.license = v.license
JOIN p_gpu_lic AS p ON p.lic_key = m.vm_license
WHERE v.num_gpu > 0 AND (p.max_gpu IS NULL OR p.max_gpu >= v.num_gpu) AND (p.min_gpu IS NULL OR p.min_gpu <= v.num_gpu)""",
    "gpu_lic_price": _first("gpu_lic_matches", "project_id, vm_id"),
    "ram_lic_matches": """SELECT v.project_id, v.vm_id, v.license, p.sku_id, p.max_usd, p.min_usd, p.pricing_unit
FROM vm_keys AS v JOIN lic_map AS m ON m.license = v.license JOIN p_ram_lic AS p ON p.lic_key = m.vm_license""",
    "ram_lic_price": _first("ram_lic_matches", "project_id, vm_id"),
    "vm_sku_rows": """SELECT project_id, vm_id, 'cpu' AS component, cpu_sku_id AS sku_id, cpu_max_usd AS rate,
  cpu_pricing_unit AS unit, v.cpus / cpus_per_core AS quantity, n_matches
FROM vm_price JOIN vm_keys AS v USING (project_id, vm_id)
UNION ALL SELECT project_id, vm_id, 'ram', ram_sku_id, ram_max_usd, ram_pricing_unit, v.memory_gb, n_matches
FROM vm_price JOIN vm_keys AS v USING (project_id, vm_id)
UNION ALL SELECT project_id, vm_id, 'gpu', sku_id, max_usd, pricing_unit, CAST(gpu_count AS DOUBLE), n_matches FROM gpu_price
UNION ALL SELECT project_id, vm_id, 'cpu_lic', sku_id, max_usd, pricing_unit, 1.0, n_matches FROM cpu_lic_price
UNION ALL SELECT project_id, vm_id, 'gpu_lic', sku_id, max_usd, pricing_unit, 1.0, n_matches FROM gpu_lic_price
UNION ALL SELECT project_id, vm_id, 'ram_lic', sku_id, max_usd, pricing_unit, v.memory_gb, n_matches
FROM ram_lic_price JOIN vm_keys AS v USING (project_id, vm_id)""",
    "disk_sku_rows": """SELECT project_id, disk_id, 'disk' AS component, sku_id, max_usd AS rate, pricing_unit AS unit,
  CAST(size_gb AS DOUBLE) AS quantity, n_matches, created FROM pd_price""",
    # run history
    "cycles": """SELECT project_id, vm_id, started, min(inventory_time) AS first_at, max(inventory_time) AS last_at,
  arg_min(last_stop, inventory_time) FILTER (WHERE status <> 'RUNNING') AS stop_seen,
  count(*) FILTER (WHERE status <> 'RUNNING') > 0 AS seen_stopped,
  arg_min(status, inventory_time) AS first_status FROM snapshots_flat GROUP BY ALL""",
    "openings": """SELECT c.project_id, c.vm_id, c.started, s.status, s.last_stop FROM cycles AS c JOIN snapshots_flat AS s
ON s.project_id = c.project_id AND s.vm_id = c.vm_id AND s.inventory_time = c.first_at GROUP BY ALL""",
    "intervals": """SELECT project_id, vm_id, started AS start, CASE WHEN seen_stopped THEN stop_seen
  WHEN next_status = 'RUNNING' THEN next_last_stop WHEN next_status IS NOT NULL THEN last_at END AS stop
FROM (SELECT c.*, lead(o.status) OVER w AS next_status, lead(o.last_stop) OVER w AS next_last_stop
  FROM cycles AS c JOIN openings AS o USING (project_id, vm_id, started)
  WINDOW w AS (PARTITION BY c.project_id, c.vm_id ORDER BY c.started))""",
    "known_intervals": f"""SELECT project_id, vm_id, started AS start, CASE WHEN seen_stopped THEN stop_seen
  WHEN next_status = 'RUNNING' THEN next_last_stop WHEN next_status IS NOT NULL THEN last_at END AS stop
FROM (SELECT c.*, lead(status_0) OVER w AS next_status, lead(last_stop_0) OVER w AS next_last_stop
  FROM (SELECT project_id, vm_id, started, max(inventory_time) AS last_at,
    arg_min(last_stop, inventory_time) FILTER (WHERE status <> 'RUNNING') AS stop_seen,
    count(*) FILTER (WHERE status <> 'RUNNING') > 0 AS seen_stopped, arg_min(status, inventory_time) AS status_0,
    first(last_stop ORDER BY inventory_time) AS last_stop_0
    FROM snapshots_flat WHERE inventory_time <= {NOW} GROUP BY ALL) AS c
  WINDOW w AS (PARTITION BY project_id, vm_id ORDER BY started))""",
    "month_uptime": f"""SELECT project_id, vm_id, floor(sum(CASE WHEN coalesce(stop, {NOW}) >= date_trunc('month', {NOW})
  THEN epoch_us(coalesce(stop, {NOW})) - epoch_us(greatest(start, date_trunc('month', {NOW}))) ELSE 0 END) / 1000000) / 60.0
  AS uptime_minutes FROM known_intervals GROUP BY ALL HAVING count(*) FILTER (WHERE stop IS NULL) > 0""",
    # hourly grid
    "slots": f"SELECT date_trunc('hour', {NOW}) - INTERVAL 1 HOUR * i AS usage_hour FROM range(13) AS t(i)",
    "vm_usage": f"""SELECT project_id, vm_id, usage_hour, (epoch_us(least({NOW}, usage_hour + INTERVAL 1 HOUR))
  - epoch_us(greatest(started, usage_hour))) / 6e7 AS minutes FROM vms CROSS JOIN slots
WHERE greatest(started, usage_hour) < least({NOW}, usage_hour + INTERVAL 1 HOUR) AND status = 'RUNNING'""",
    "stopped_usage": f"""SELECT project_id, vm_id, usage_hour, (epoch_us(least(last_stop, usage_hour + INTERVAL 1 HOUR))
  - epoch_us(greatest(started, usage_hour))) / 6e7 AS minutes FROM vms CROSS JOIN slots
WHERE greatest(started, usage_hour) < least(last_stop, usage_hour + INTERVAL 1 HOUR) AND status <> 'RUNNING'""",
    "disk_usage": f"""SELECT project_id, disk_id, usage_hour, (epoch_us(least({NOW}, usage_hour + INTERVAL 1 HOUR))
  - epoch_us(greatest(created, usage_hour))) / 6e7 AS minutes FROM disks_flat CROSS JOIN slots
WHERE greatest(created, usage_hour) < least({NOW}, usage_hour + INTERVAL 1 HOUR)""",
    # only prices in the unit a component is billed by may be costed; a machine may lack a memory price
    "usable_vm_rows": """SELECT * FROM vm_sku_rows WHERE (component IN ('cpu', 'gpu', 'cpu_lic', 'gpu_lic') AND unit = 'HOUR')
  OR (component IN ('ram', 'ram_lic') AND unit = 'GIBIBYTE_HOUR') OR (component = 'ram' AND unit IS NULL)""",
    "usable_disk_rows": "SELECT * FROM disk_sku_rows WHERE unit = 'GIBIBYTE_MONTH'",
    "calc_rows": """SELECT project_id, usage_hour, sku_id, minutes / 60 * coalesce(rate, 0) * quantity AS cost
FROM vm_usage JOIN usable_vm_rows USING (project_id, vm_id) WHERE sku_id IS NOT NULL
UNION ALL SELECT project_id, usage_hour, sku_id, rate * (minutes / 60 / 730.0) * quantity
FROM disk_usage JOIN usable_disk_rows USING (project_id, disk_id)""",
    "calc": "SELECT project_id, usage_hour, sku_id, sum(cost) AS calc FROM calc_rows GROUP BY ALL HAVING sum(cost) <> 0",
    "vm_intervals": f"""SELECT project_id, vm_id, i.name AS interval, hours, sum(hours * coalesce(rate, 0)
  * CASE WHEN component = 'cpu' THEN 1 ELSE quantity END) AS cost FROM (
  SELECT *, CASE i.name WHEN 'uptime' THEN up WHEN 'last_day' THEN least(up, 24) ELSE 1 END AS hours
  FROM (SELECT project_id, vm_id, (epoch_us({NOW}) - epoch_us(started)) / 3.6e9 AS up FROM vms WHERE status = 'RUNNING') AS v,
    (VALUES ('uptime'), ('last_day'), ('hourly')) AS i(name)) AS i JOIN usable_vm_rows USING (project_id, vm_id) GROUP BY ALL""",
    "disk_intervals": f"""SELECT project_id, disk_id, i.name AS interval, CASE i.name WHEN 'uptime' THEN up
  WHEN 'last_day' THEN least(up, 24) ELSE 1 END AS hours, CASE i.name WHEN 'uptime' THEN up WHEN 'last_day'
  THEN least(up, 24) ELSE 1 END / 24.0 / 30.0 * rate * quantity AS cost
FROM (SELECT *, (epoch_us({NOW}) - epoch_us(created)) / 3.6e9 AS up FROM usable_disk_rows) AS v,
  (VALUES ('uptime'), ('last_day'), ('hourly')) AS i(name)""",
    "burn": """SELECT project_id, {cells}, count(*) FILTER (WHERE kind = 'running') AS vm_count, {totals}
FROM (SELECT project_id, interval, cost, 'vm' AS kind FROM vm_intervals
  UNION ALL SELECT project_id, interval, cost, 'disk' FROM disk_intervals
  UNION ALL SELECT project_id, NULL, 0, 'running' FROM vms WHERE status = 'RUNNING') GROUP BY ALL""".format(
        cells=", ".join(f"sum(CASE WHEN kind = '{k}' AND interval = '{i}' THEN cost ELSE 0 END) AS {k}_{i}"
                        for i in ("uptime", "last_day", "hourly") for k in ("vm", "disk")),
        totals=", ".join(f"sum(CASE WHEN interval = '{i}' THEN cost ELSE 0 END) AS total_{i}"
                         for i in ("uptime", "last_day", "hourly"))),
    # billing
    "seen_billing": f"""SELECT *, CAST(cost AS DECIMAL(28, 9)) AS exact FROM billing_flat
WHERE export_time <= {NOW} AND export_date > CAST({NOW} - INTERVAL 2 DAY AS DATE)""",
    "charge_slots": """SELECT project_id, service AS description, sku_id, sku_description, usage_start_time, usage_end_time,
  min(export_time) AS first_export, max(export_time) AS last_export, CAST(round(sum(exact), 5) AS DOUBLE) AS total_cost
FROM seen_billing WHERE cost > 0.00001 GROUP BY ALL""",
    "charges": f"""SELECT *, CAST((epoch_us({NOW}) - epoch_us(usage_end_time)) // 1000000 AS BIGINT) AS delay_seconds
FROM (SELECT *, rank() OVER (PARTITION BY project_id, sku_id ORDER BY usage_end_time DESC) AS rank FROM charge_slots)
WHERE rank <= 4""",
    "window_charges": f"""SELECT * FROM charge_slots
WHERE usage_start_time >= date_trunc('hour', {NOW}) - INTERVAL 12 HOUR""",
    "reconciled": """SELECT coalesce(c.project_id, g.project_id) AS project_id, coalesce(c.usage_hour, g.usage_hour) AS usage_hour,
  coalesce(c.sku_id, g.sku_id) AS sku_id, coalesce(d.text, 'No description collected') AS sku_description,
  coalesce(c.calc, 0) AS calc, coalesce(g.reported, 0) AS reported, coalesce(c.calc, 0) - coalesce(g.reported, 0) AS delta
FROM calc AS c FULL OUTER JOIN (SELECT project_id, date_trunc('hour', usage_start_time) AS usage_hour, sku_id,
  sum(total_cost) AS reported FROM window_charges GROUP BY ALL) AS g
  ON g.project_id = c.project_id AND g.usage_hour = c.usage_hour AND g.sku_id = c.sku_id
LEFT JOIN (SELECT project_id, sku_id, min(sku_description) AS text FROM window_charges GROUP BY ALL) AS d
  ON d.project_id = coalesce(c.project_id, g.project_id) AND d.sku_id = coalesce(c.sku_id, g.sku_id)
WHERE coalesce(c.calc, 0) <> 0 OR coalesce(g.reported, 0) <> 0""",
    "fees": "SELECT project_id, sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS additional_fees FROM reconciled GROUP BY ALL",
    "hourly": f"""SELECT project_id, sum(calc) AS per_hour_charge FROM calc
WHERE usage_hour = date_trunc('hour', {NOW}) - INTERVAL 1 HOUR GROUP BY ALL""",
    "interval_cost": """SELECT project_id, interval_start, cost, budget, event_time, message_id FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, interval_start ORDER BY event_time DESC, message_id DESC) AS rn
  FROM alerts_flat) WHERE rn = 1""",
    "spend": """SELECT project_id, CAST(sum(CAST(cost AS DECIMAL(28, 9))) AS DOUBLE) AS reported_spend,
  last(budget ORDER BY event_time, message_id) AS budget FROM interval_cost GROUP BY ALL""",
    "status": """SELECT *, CASE WHEN remaining > 0 THEN remaining / NULLIF(per_hour_charge, 0) END AS hours_left,
  coalesce(fraction >= 1, false) AS over_budget FROM (SELECT project_id, budget, reported_spend,
  coalesce(additional_fees, 0) AS additional_fees, reported_spend + coalesce(additional_fees, 0) AS total_spend, per_hour_charge,
  (reported_spend + coalesce(additional_fees, 0)) / NULLIF(budget, 0) AS fraction,
  budget - (reported_spend + coalesce(additional_fees, 0)) AS remaining
FROM spend LEFT JOIN fees USING (project_id) LEFT JOIN hourly USING (project_id))""",
    "egress": """SELECT project_id, CAST(sum(CAST(cost AS DECIMAL(28, 9))) AS DOUBLE) AS total_egress FROM billing_flat
WHERE sku_description LIKE '%ownload%' OR sku_description LIKE '%gress%' GROUP BY ALL""",
    "cpus": "SELECT project_id, sum(cpus) AS total_cpus FROM vms WHERE status = 'RUNNING' GROUP BY ALL",
}

_ENABLED = "WHERE project_id IN (SELECT project_id FROM settings_flat WHERE compute_enabled)"
#: What a controller run starts from: enabled projects, machines listed in the last two days, and disks still listed.
OF_RUN = {"vms": f"SELECT * FROM ({RELATIONS['vms']}) AS x {_ENABLED} AND inventory_time >= {NOW} - INTERVAL 2 DAY",
          "disks_flat": f"SELECT * FROM ({A.disks_flat(A.of_some('customer', A.DISK_STAYS))}) AS x {_ENABLED}"}

_SOURCE = re.compile(r"(?:FROM|JOIN)\s+([a-z_]\w*)")


def oracle(final: str, replaced: dict[str, str] | None = None) -> str:
    """``final`` with the relations it names, and those they name, in front of it.

    ``replaced`` gives some of them another definition.
    """
    relations = {**RELATIONS, **(replaced or {})}
    order: list[str] = []

    def need(text: str) -> None:
        for word in dict.fromkeys(_SOURCE.findall(text)):
            if word in relations and word not in order:
                need(relations[word])
                if word not in order:
                    order.append(word)

    need(final)
    ctes = ",\n".join(f"{n} AS ({relations[n]})" for n in order)
    return f"WITH {ctes}\n{final}" if order else final
