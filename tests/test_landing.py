"""How derived tables are landed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyforge.session import scratch_path, write_folders
from tallyforge.workload import adapters
from tallyforge.workload import landing
from tallyforge.workload.q_billing import run_inputs

SF = "/root/testdata/sf0.001"


def test_export_is_landed_by_the_tasks_that_read_it(spark, monkeypatch):
    """Three dates in each of four tasks: no date is gathered in one task."""
    days = F.date_add(F.lit("2024-01-10").cast("date"), (F.col("id") % 3).cast("int"))
    monkeypatch.setattr(landing.A, "billing_export", lambda *_: spark.range(0, 1200, 1, 4).withColumn("export_date", days))
    monkeypatch.setattr(landing, "_LANDED", {})
    rows = landing.billing_export(spark, "dates")
    named = rows.select("export_date", F.input_file_name().alias("file"))
    files = named.groupBy("export_date").agg(F.countDistinct("file").alias("files"), F.count("*").alias("n")).collect()
    assert [(r["files"], r["n"]) for r in files] == [(4, 400)] * 3


def test_more_folders_than_are_open_at_once(spark):
    path, before = scratch_path(spark, "folders"), spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    rows = spark.range(0, 1000, 1, 2).withColumn("folder", F.col("id") % 100)
    write_folders(rows, path, ("folder",))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    back = spark.read.parquet(path).groupBy("folder").agg(F.sum("id").alias("total")).collect()
    assert {r["folder"]: r["total"] for r in back} == {f: sum(range(f, 1000, 100)) for f in range(100)}


@pytest.mark.parametrize("name, lands", [
    ("one_price", {"sku-export", "price-rows"}), ("disk_cost", {"sku-export", "price-rows"}),
    ("burn_projection", {"sku-export", "price-rows", "price-cards", "disk-card", "vm-state"})])
def test_queries_land_what_they_read(spark, monkeypatch, name, lands):
    monkeypatch.setattr(landing, "_LANDED", {})
    entry.queries()[name](spark, SF)
    assert {table for *_, table in landing._LANDED} == lands


def test_a_run_does_not_land_a_state_it_replaces(spark, monkeypatch):
    monkeypatch.setattr(landing, "_LANDED", {})
    run_inputs(spark, SF)
    assert "listed-state" in {table for *_, table in landing._LANDED} and "vm-state" not in {table for *_, table in landing._LANDED}


@pytest.mark.parametrize("build", [adapters.sku_export, adapters.listed_disk_pages])
def test_dear_rows_of_one_row_group_are_spread(spark, build):
    rows = build(spark, SF)
    cores = spark.sparkContext.defaultParallelism
    assert cores > 1 and len([n for n in rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]) == cores
