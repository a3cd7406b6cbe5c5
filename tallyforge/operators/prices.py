"""Price tables cut out of the nested SKU export.

Every table is one scan, one filter pushed below the unnest, the unnest of
regions where the table has them, and one partially aggregated group-by. The
tiers are folded per row before anything is exploded, since only the largest
and smallest tier survive.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge import constants as C
from tallyforge.functions.keys import extract_or_null


def _desc() -> Column:
    return F.col("description")


def flatten_skus(export: DataFrame) -> DataFrame:
    """Columns the price tables need, one row per SKU with at least one tier."""
    tiers = F.col("billing_account_price.tiered_rates.usd_amount")
    return export.where(F.size(tiers) > 0).select(
        F.col("sku.id").alias("sku_id"),
        F.col("sku.description").alias("description"),
        F.col("service.description").alias("service"),
        F.col("geo_taxonomy.regions").alias("regions"),
        "pricing_unit",
        F.array_max(tiers).alias("tier_max"),
        F.array_min(tiers).alias("tier_min"),
    )


def _skus(export: DataFrame) -> DataFrame:
    """The export flattened, unless it is already."""
    return export if "tier_max" in export.columns else flatten_skus(export)


def _has(fragment: str) -> Column:
    return _desc().contains(fragment)


def _any(*fragments: str) -> Column:
    return reduce(Column.__or__, [_has(f) for f in fragments])


def _compute() -> Column:
    return F.col("service").contains(C.COMPUTE_SERVICE_FRAGMENT)


def _regular() -> Column:
    return ~_any(*C.EXCLUDED_FRAGMENTS)


@dataclass(frozen=True)
class Table:
    """Which rows a price table takes, its key columns, and whether it has a row per region."""

    keep: Column
    keys: dict[str, Column]
    by_region: bool


def _fold(skus: DataFrame, table: Table) -> DataFrame:
    rows = skus.where(table.keep)
    region = {"region": F.explode("regions")} if table.by_region else {}
    named = {**table.keys, **region}
    cols = [c.alias(n) for n, c in named.items()]
    return (
        rows.select(*cols, "sku_id", "pricing_unit", "tier_max", "tier_min")
        .groupBy(*named, "sku_id", "pricing_unit")
        .agg(F.max("tier_max").alias("max_usd"), F.min("tier_min").alias("min_usd"))
        .select(*named, "sku_id", "max_usd", "min_usd", "pricing_unit")
    )


def _preemptible() -> Column:
    return _has(C.PREEMPTIBLE_FRAGMENT)


def _core_key() -> Column:
    key = extract_or_null(_desc(), C.CORE_KEY_PATTERN)
    key = F.replace(key, F.lit("Preemptible "), F.lit(" "))
    return F.trim(F.replace(key, F.lit("running"), F.lit("")))


def _cpu() -> Table:
    keep = _any("Instance", "Core") & _regular() & ~_has("Ram") & _compute()
    keys = {"cpu": _core_key(), "preemptible": _preemptible()}
    return Table(keep, keys, by_region=True)


def _ram() -> Table:
    keep = _any("Instance", "Core", "Ram") & _regular() & _any("Ram", "RAM") & _compute()
    keys = {"cpu": _core_key(), "preemptible": _preemptible()}
    return Table(keep, keys, by_region=True)


def _gpu() -> Table:
    keep = _has("GPU") & _regular() & ~_has("Ram") & _compute()
    key = F.concat(F.lit("Nvidia "), extract_or_null(_desc(), C.GPU_KEY_PATTERN))
    return Table(keep, {"gpu": key, "preemptible": _preemptible()}, by_region=True)


def _pd() -> Table:
    key = F.concat(extract_or_null(_desc(), C.PD_KEY_PATTERN), F.lit(" PD Capacity"))
    key = F.trim(F.replace(key, F.lit("Regional "), F.lit("")))
    return Table(_has("PD Capacity"), {"pd": key, "is_regional": _has("Regional")}, by_region=True)


def _ip() -> Table:
    key = F.trim(extract_or_null(_desc(), C.IP_KEY_PATTERN))
    return Table(_has(" IP ") & _compute(), {"ip_key": key, "preemptible": _preemptible()}, by_region=False)


def _bound(pattern: str, unit: str) -> Column:
    return extract_or_null(_desc(), pattern.format(unit=unit)).try_cast("bigint")


def _is_range() -> Column:
    return _desc().like("% on VM with % to %")


def _upper_bound(unit: str) -> Column:
    """Largest machine a license price covers. "up to" also looks like a range, so it goes first."""
    return (F.when(_has(" on VM with up to "), _bound(C.UP_TO_PATTERN, unit))
            .when(_is_range(), _bound(C.RANGE_HIGH_PATTERN, unit)))


def _lower_bound(unit: str) -> Column:
    return (F.when(_has(" or more "), _bound(C.OR_MORE_PATTERN, unit))
            .when(_is_range(), _bound(C.RANGE_LOW_PATTERN, unit)))


def _flat_license_key(note: str) -> Column:
    return F.trim(F.replace(extract_or_null(_desc(), C.LICENSE_PATTERN), F.lit(note), F.lit("")))


def _gpu_lic() -> Table:
    key = F.when(_has(" on VM with "), F.trim(extract_or_null(_desc(), C.LICENSE_ON_VM_PATTERN))).otherwise(
        _flat_license_key("(GPU cost)"))
    keys = {"lic_key": key, "min_gpu": _lower_bound("GPU"), "max_gpu": _upper_bound("GPU")}
    return Table(_has("Licen") & _has("GPU") & _compute(), keys, by_region=False)


def _cpu_lic() -> Table:
    on_class = [_has(f" on {m}") for m in C.SMALL_MACHINE_CLASSES]
    machine_class = F.coalesce(*[F.when(on, F.lit(m)) for on, m in zip(on_class, C.SMALL_MACHINE_CLASSES)])
    key = (F.when(_has(" on VM with "), F.trim(extract_or_null(_desc(), C.LICENSE_ON_VM_PATTERN)))
           .when(reduce(Column.__or__, on_class), F.trim(extract_or_null(_desc(), C.LICENSE_ON_CLASS_PATTERN)))
           .otherwise(_flat_license_key("(CPU cost)")))
    exact = _desc().like("% on VM with % VCPU")
    exact_size = _bound(C.EXACT_PATTERN, "VCPU")
    keys = {
        "machine_class": machine_class,
        "lic_key": key,
        "min_cpu": _lower_bound("VCPU").when(exact, exact_size),
        "max_cpu": _upper_bound("VCPU").when(exact, exact_size),
    }
    keep = _has("Licen") & ~_has("GPU") & ~_has("RAM cost") & _compute()
    return Table(keep, keys, by_region=False)


def _ram_lic() -> Table:
    return Table(_has("Licen") & _has("RAM") & _compute(), {"lic_key": _flat_license_key("(RAM cost)")}, by_region=False)


TABLES = {"cpu": _cpu, "ram": _ram, "gpu": _gpu, "pd": _pd, "cpu_lic": _cpu_lic, "gpu_lic": _gpu_lic, "ram_lic": _ram_lic, "ip": _ip}


def pricing(export: DataFrame, name: str) -> DataFrame:
    """One price table alone."""
    return _fold(_skus(export), TABLES[name]())


def cpu_pricing(export: DataFrame) -> DataFrame:
    """Core prices per key, preemptibility, region and SKU."""
    return pricing(export, "cpu")


def ram_pricing(export: DataFrame) -> DataFrame:
    """Memory prices; the key column keeps the name ``cpu``."""
    return pricing(export, "ram")


def gpu_pricing(export: DataFrame) -> DataFrame:
    """Accelerator prices; rows whose description has no model keep a NULL key."""
    return pricing(export, "gpu")


def pd_pricing(export: DataFrame) -> DataFrame:
    """Persistent-disk prices of all services."""
    return pricing(export, "pd")


def ip_pricing(export: DataFrame) -> DataFrame:
    """Address prices, regions ignored."""
    return pricing(export, "ip")


def gpu_lic_pricing(export: DataFrame) -> DataFrame:
    """License prices per accelerator count band."""
    return pricing(export, "gpu_lic")


def cpu_lic_pricing(export: DataFrame) -> DataFrame:
    """License prices per CPU count band or shared-core machine class."""
    return pricing(export, "cpu_lic")


def ram_lic_pricing(export: DataFrame) -> DataFrame:
    """License prices per gibibyte of memory."""
    return pricing(export, "ram_lic")


# --- all tables in one pass --------------------------------------------------------

#: The tables' own key names under which ``price_rows`` has them together.
SHARED = {"cpu": "price_key", "gpu": "price_key", "pd": "price_key", "ip_key": "price_key", "lic_key": "price_key",
          "min_cpu": "least", "max_cpu": "most", "min_gpu": "least", "max_gpu": "most"}
_KEYS = {"price_key": "string", "preemptible": "boolean", "is_regional": "boolean", "machine_class": "string",
         "least": "bigint", "most": "bigint"}


def price_rows(export: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """The rows of all named tables, tagged by ``price_table``: one scan, one aggregate, one shuffle.

    A SKU is tagged with the tables that take it, one row each, before the
    regions are spread; keys that a table lacks are NULL.
    """
    tagged = []
    for name in TABLES if names is None else names:
        table = TABLES[name]()
        own = {SHARED.get(k, k): c for k, c in table.keys.items()}
        keys = [(own[k] if k in own else F.lit(None)).cast(kind).alias(k) for k, kind in _KEYS.items()]
        regions = F.col("regions") if table.by_region else F.array(F.lit(None).cast("string"))
        tagged.append(F.when(table.keep, F.struct(F.lit(name).alias("price_table"), *keys, regions.alias("_regions"))))
    rows = _skus(export).select("sku_id", "pricing_unit", "tier_max", "tier_min", F.inline(F.array_compact(F.array(*tagged))))
    keys = ["price_table", *_KEYS, "region"]
    return (rows.withColumn("region", F.explode("_regions")).groupBy(*keys, "sku_id", "pricing_unit")
            .agg(F.max("tier_max").alias("max_usd"), F.min("tier_min").alias("min_usd"))
            .select(*keys, "sku_id", "max_usd", "min_usd", "pricing_unit"))


def table_of(rows: DataFrame, name: str) -> DataFrame:
    """One table out of ``price_rows``, under its own column names."""
    table = TABLES[name]()
    named = [F.col(SHARED.get(k, k)).alias(k) for k in table.keys]
    return rows.where(F.col("price_table") == name).select(
        *named, *(["region"] if table.by_region else []), "sku_id", "max_usd", "min_usd", "pricing_unit")
