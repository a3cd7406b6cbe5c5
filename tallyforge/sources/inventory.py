"""Landed inventory pages, one JSON document per API page, to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge import constants as C
from tallyforge import schemas
from tallyforge.functions.keys import last_path_segment, num_gpu, parse_rfc3339


def _zone_items(pages: DataFrame, raw: str, schema: T.StructType, field: str) -> DataFrame:
    """One row per resource of a page: the page is a map zone -> list or warning."""
    parsed = pages.withColumn("_page", F.from_json(raw, schema, {"mode": "PERMISSIVE"}))
    kept = [c for c in pages.columns if c != raw]
    zones = parsed.select(*kept, F.explode("_page.items").alias("_zone", "_scope"))
    listed = zones.where(F.coalesce(F.col("_scope.warning.code") != C.EMPTY_PAGE_CODE, F.lit(True)))
    return listed.select(
        *kept, last_path_segment("_zone").alias("zone"), F.explode(f"_scope.{field}").alias("_item"))


def rejected_pages(pages: DataFrame, schema: T.StructType, raw: str = "raw_json") -> DataFrame:
    """Pages that are no document of ``schema``, as they came, with ``reason``; the flatteners leave them out."""
    broken = F.from_json(raw, T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]),
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = pages.withColumn("_page", broken)
    reason = (F.when(F.col(raw).isNull(), "no document").when(F.col("_page._bad").isNotNull(), "malformed document")
              .when(F.col("_page.items").isNull(), "no items"))
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select(*pages.columns, "reason")


def _accelerator(entry: Column) -> Column:
    parts = F.split(entry["acceleratorType"], "/")
    return F.struct(
        entry["acceleratorCount"].alias("count"),
        F.element_at(parts, -3).alias("zone"),
        F.element_at(parts, -1).alias("type"),
    )


def flatten_vm_inventory(pages: DataFrame, raw: str = "raw_json") -> DataFrame:
    """One row per VM. The license is the first one of the first disk, NULL when there is none.

    Columns of ``pages`` besides the document (project_id, inventory_time) are kept.
    """
    kept = [c for c in pages.columns if c != raw]
    item = F.col("_item")
    first_disk = F.get(item["disks"], F.lit(0))
    accelerators = F.transform(F.coalesce(item["guestAccelerators"], F.array()), _accelerator)
    return _zone_items(pages, raw, schemas.VM_PAGE, "instances").select(
        *kept,
        item["id"].alias("vm_id"),
        item["name"].alias("name"),
        "zone",
        item["status"].alias("status"),
        last_path_segment(item["machineType"]).alias("machine_type"),
        last_path_segment(F.get(first_disk["licenses"], F.lit(0))).alias("license"),
        parse_rfc3339(item["creationTimestamp"], strict=False).alias("created"),
        parse_rfc3339(item["lastStartTimestamp"], strict=False).alias("started"),
        parse_rfc3339(item["lastStopTimestamp"], strict=False).alias("last_stop"),
        first_disk["diskSizeGb"].alias("first_disk_size"),
        first_disk["kind"].alias("first_disk_kind"),
        item["scheduling"]["preemptible"].alias("preemptible"),
        accelerators.alias("accel"),
        num_gpu(item["guestAccelerators"]).alias("num_gpu"),
    )


def flatten_disk_inventory(pages: DataFrame, raw: str = "raw_json") -> DataFrame:
    """One row per disk. Regional disks have a region and more than one replica zone."""
    kept = [c for c in pages.columns if c != raw]
    item = F.col("_item")
    regional = item["region"].isNotNull() & (F.coalesce(F.size(item["replicaZones"]), F.lit(0)) > 1)
    return _zone_items(pages, raw, schemas.DISK_PAGE, "disks").select(
        *kept,
        item["id"].alias("disk_id"),
        "zone",
        item["name"].alias("name"),
        parse_rfc3339(item["creationTimestamp"], strict=False).alias("created"),
        item["sizeGb"].cast("int").alias("size_gb"),
        regional.alias("is_regional"),
        F.when(regional, last_path_segment(item["region"])).alias("disk_region"),
        last_path_segment(item["type"]).alias("type"),
    )


def machine_type_dim(machine_types: DataFrame) -> DataFrame:
    """One row per (zone, machine type) out of landed type descriptions.

    Input columns are zone (URL or name), name, guestCpus and memoryMb. A type
    described more than once keeps its largest description, so the result does
    not depend on arrival order.
    """
    return (
        machine_types.groupBy(
            last_path_segment("zone").alias("zone"), last_path_segment("name").alias("machine_type"))
        .agg(F.max(F.struct(F.col("guestCpus").cast("double").alias("cpus"),
                            F.col("memoryMb").cast("int").alias("memory_mb"))).alias("_t"))
        .select("zone", "machine_type", "_t.cpus", "_t.memory_mb")
    )


def with_machine_type(vms: DataFrame, machine_types: DataFrame) -> DataFrame:
    """VMs with CPU count and memory of their type."""
    return vms.join(machine_types, ["zone", "machine_type"], "left")
