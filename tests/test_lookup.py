"""Lookup rules on small price tables."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators import estimate as E
from tallyforge.operators import lookup as L
from tallyforge.session import shared_dir

PRICE = "cpu string, preemptible boolean, region string, sku_id string, max_usd double, min_usd double, pricing_unit string"
VM = ("project_id string, vm_id string, zone string, machine_type string, preemptible boolean, license string, "
      "cpus double, memory_mb int, accel array<struct<count:int,zone:string,type:string>>, status string, "
      "started timestamp, last_stop timestamp")


def vm(spark, *rows):
    full = []
    for r in rows:
        base = dict(project_id="p", vm_id="v", zone="us-east1-b", machine_type="n1-standard-4", preemptible=False,
                    license="debian-9-stretch", cpus=4.0, memory_mb=2048, accel=[], status="RUNNING", started=None,
                    last_stop=None)
        base.update(r)
        full.append(tuple(base.values()))
    return spark.createDataFrame(full, VM)


@pytest.fixture(scope="module")
def core(spark):
    cpu = spark.createDataFrame([
        ("N1 Predefined Instance Core", False, "us-east1", "C1", 0.03, 0.01, "HOUR"),
        ("N1 Predefined Instance Core", False, "us-east1", "C0", 0.03, 0.01, "HOUR"),
        ("N1 Predefined Instance Core", False, "us-east1", "C2", 0.02, 0.01, "HOUR"),
        ("N1 Predefined Instance Core", True, "us-east1", "C3", 0.01, 0.01, "HOUR"),
        ("Micro Instance with burstable CPU", False, "us-east1", "F1", 0.007, 0.007, "HOUR"),
        ("N2 Instance Core", False, "us-east1", "N2", 0.05, 0.05, "HOUR"),
        ("E2 Instance Core", False, "us-east1", "E2", 0.05, 0.05, "HOUR"),
        (None, False, "us-east1", "X", 9.0, 9.0, "HOUR"),
    ], PRICE)
    ram = spark.createDataFrame([
        ("N1 Predefined Instance Ram", False, "us-east1", "R1", 0.004, 0.004, "GIBIBYTE_HOUR"),
        ("N2 Instance Ram", False, "us-west1", "R2", 0.004, 0.004, "GIBIBYTE_HOUR"),
    ], PRICE)
    return cpu, ram, schemas.shipped_mapping(spark, "machine_key_to_cpu")


def test_vm_price_left_join_then_filter(spark, core):
    vms = vm(spark, {"vm_id": "n1"}, {"vm_id": "spot", "preemptible": True}, {"vm_id": "f1", "machine_type": "f1-micro"},
             {"vm_id": "n2", "machine_type": "n2-standard-2"}, {"vm_id": "e2", "machine_type": "e2-micro"})
    rows = {r["vm_id"]: r for r in L.vm_price_lookup(vms, *core).collect()}
    # memory priced for other regions or the other preemptibility only: dropped
    assert set(rows) == {"n1", "f1", "e2"}
    # equal price: smallest SKU id; three matches for one memory price
    assert (rows["n1"]["cpu_sku_id"], rows["n1"]["ram_sku_id"], rows["n1"]["n_matches"]) == ("C0", "R1", 3)
    # no memory key at all, and a key no memory row has: kept without memory price
    assert rows["f1"]["ram_sku_id"] is None
    assert (rows["e2"]["ram_sku_id"], rows["e2"]["cpus_per_core"]) == (None, 8)


def test_strict_mode_fails_on_several(spark, core):
    prices = core[0].where("cpu LIKE 'N1%'")
    with pytest.raises(PySparkException, match="too many prices"):
        L.one_price(prices, ["cpu", "region", "preemptible"], "strict").collect()
    assert L.one_price(prices.where("sku_id = 'C3'"), ["cpu"], "strict").count() == 1
    with pytest.raises(ValueError):
        L.one_price(prices, ["cpu"], "any")


def test_license_bands(spark):
    prices = spark.createDataFrame([
        (None, "Debian 9 Stretch", None, 4, "UPTO4", 1.0, 1.0, "HOUR"),
        (None, "Debian 9 Stretch", 5, None, "FROM5", 2.0, 2.0, "HOUR"),
        (None, "Debian 9 Stretch", 8, 8, "JUST8", 3.0, 3.0, "HOUR"),
        ("f1-micro", "Debian 9 Stretch", None, None, "F1", 0.1, 0.1, "HOUR"),
    ], "machine_class string, lic_key string, min_cpu long, max_cpu long, sku_id string, max_usd double, min_usd double, "
       "pricing_unit string")
    lic = schemas.shipped_mapping(spark, "lic_key_to_lic")
    vms = vm(spark, {"vm_id": "4", "cpus": 4.0}, {"vm_id": "5", "cpus": 5.0}, {"vm_id": "8", "cpus": 8.0},
             {"vm_id": "f1", "machine_type": "f1-micro", "cpus": 1.0}, {"vm_id": "none", "license": None},
             {"vm_id": "g1", "machine_type": "g1-small", "cpus": 1.0})
    rows = {r["vm_id"]: (r["sku_id"], r["n_matches"]) for r in L.cpu_lic_lookup(vms, prices, lic).collect()}
    assert rows == {"4": ("UPTO4", 1), "5": ("FROM5", 1), "8": ("JUST8", 2), "f1": ("F1", 1)}


def test_rate_card_and_costs(spark, core):
    none = "machine_class string, lic_key string, min_cpu long, max_cpu long, sku_id string, max_usd double, min_usd double, pricing_unit string"
    gpu = spark.createDataFrame([("Nvidia Tesla T4", False, "us-east1", "G", 0.35, 0.35, "HOUR")],
                                PRICE.replace("cpu string", "gpu string"))
    lic = spark.createDataFrame([(None, "Debian 9 Stretch", None, None, "L", 0.0, 0.0, "HOUR")], none)
    gpu_lic = spark.createDataFrame([], none.replace("machine_class string, ", "").replace("_cpu", "_gpu"))
    ram_lic = spark.createDataFrame([("Debian 9 Stretch", "M", 0.5, 0.5, "HOUR")],
                                    "lic_key string, sku_id string, max_usd double, min_usd double, pricing_unit string")
    prices = {"cpu": core[0], "ram": core[1], "gpu": gpu, "cpu_lic": lic, "gpu_lic": gpu_lic, "ram_lic": ram_lic}
    maps = {n: schemas.shipped_mapping(spark, n) for n in schemas.MAPPINGS}
    t4 = {"count": 2, "zone": "us-east1-b", "type": "nvidia-tesla-t4"}
    vms = vm(spark, {"vm_id": "n1", "accel": [t4, t4]}, {"vm_id": "far", "zone": "eu-1-a"})
    card = L.rate_card(vms, prices, maps)
    rows = sorted((r["component"], r["sku_id"], r["quantity"]) for r in L.vm_skus(vms, card).where("vm_id = 'n1'").collect())
    assert rows == [("cpu", "C0", 4.0), ("cpu_lic", "L", 1.0), ("gpu", "G", 2.0), ("gpu", "G", 2.0), ("ram", "R1", 2.0),
                    ("ram_lic", "M", 2.0)]
    missing = {(r["resource_id"], r["missing"]) for r in L.unpriced_resources(vms, card).collect()}
    assert missing == {("n1", "gpu_lic"), ("far", "vm")}

    skus = L.vm_skus(vms, card).where("vm_id = 'n1'").withColumn("hours", F.lit(10.0))
    cost = {(r["component"]): r["cost"] for r in E.core_ram_cost(skus).collect()}
    assert cost == pytest.approx({"cpu": 10 * 0.03 * 4, "ram": 10 * 0.004 * 2})
    assert sum(r["cost"] for r in E.gpu_cost(skus).collect()) == pytest.approx(2 * 10 * 0.35 * 2)
    # memory license priced per hour instead of per gibibyte hour
    bad = {r["component"] for r in E.check_units(skus).where("NOT unit_ok").collect()}
    assert bad == {"ram_lic"}
    with pytest.raises(PySparkException, match="unexpected pricing units"):
        E.check_units(skus, strict=True).collect()


def test_shared_dir_follows_the_session(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert before or "tallyforge-" in shared_dir(spark)
