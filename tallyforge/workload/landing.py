"""Tables a deployment would have on storage: the SKU export, its price tables, the VM state.

They are derived from the given tables by Spark, written once per session and
table folder, and read back as plain Parquet, so queries scan real nested
columns with pruning and pushdown, and small tables carry their true size.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import inventory as I
from tallyforge.operators import lookup as L
from tallyforge.operators import prices as P
from tallyforge.plans.inventory import inventory_state
from tallyforge.session import scratch_path, write_folders
from tallyforge.sources.inventory import flatten_disk_inventory
from tallyforge.workload import adapters as A

_LANDED: dict[tuple[str, str, str], tuple[str, object]] = {}


def landed(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """``build()`` written once; later calls read what is there."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _LANDED:
        df = build()
        path = scratch_path(spark, name)
        write_folders(df, path, by)
        _LANDED[key] = (path, df.schema)
    path, schema = _LANDED[key]
    return spark.read.schema(schema).parquet(path)


def sku_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "sku-export", lambda: A.sku_export(spark, sf_dir))


def price_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The eight price tables as written by the build, from one scan of the export."""
    rows = landed(spark, sf_dir, "price-rows", lambda: P.price_rows(sku_export(spark, sf_dir)), ("price_table",))
    return {name: P.table_of(rows, name) for name in P.TABLES}


def price_cards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The machine and disk cards that the build writes next to the price tables."""
    prices, maps = price_tables(spark, sf_dir), A.mappings(spark)
    return (landed(spark, sf_dir, "price-cards", lambda: L.price_cards(prices, maps)),
            landed(spark, sf_dir, "disk-card", lambda: L.pd_card(prices["pd"], maps["pd_key_to_pd"])))


def billing_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The billing export in its date partitions."""
    return landed(spark, sf_dir, "billing-export", lambda: A.billing_export(spark, sf_dir), ("export_date",))


def vm_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "vm-pages", lambda: A.vm_pages(spark, sf_dir))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the machines polled in the last two days, as one listing."""
    since = F.col("inventory_time") >= F.lit(A.AS_OF - timedelta(days=2))
    return landed(spark, sf_dir, "listing", lambda: A.vm_listing(spark, sf_dir, I.latest_vms(A.vm_snapshots(spark, sf_dir).where(since), A.AS_OF)))


def machine_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "machine-types", lambda: A.machine_type_records(spark, sf_dir))


def listed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of three days ago brought up to date by the listing."""
    before = I.latest_vms(A.vm_snapshots(spark, sf_dir), A.AS_OF - timedelta(days=3))
    enabled = A.project_settings(spark, sf_dir).where("compute_enabled")
    return landed(spark, sf_dir, "listed-state", lambda: inventory_state(
        before, listing(spark, sf_dir), machine_types(spark, sf_dir), enabled))


def listed_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disks that the last listing shows."""
    return landed(spark, sf_dir, "listed-disks", lambda: flatten_disk_inventory(A.listed_disk_pages(spark, sf_dir)))


def current_vms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The VM state: newest snapshot of every VM."""
    return landed(spark, sf_dir, "vm-state", lambda: I.latest_vms(A.vm_snapshots(spark, sf_dir), A.AS_OF))
