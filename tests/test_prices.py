"""Description shapes and what each price table makes of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators import prices as P
from tallyforge.plans.price_tables import build_price_tables

DESCRIPTIONS = [
    "N1 Predefined Instance Core running in Americas",
    "Preemptible N1 Predefined Instance Core running in Americas",
    "N1 Predefined Instance Ram running in Americas",
    "Commitment v1: Cpu Core in Americas",
    "Sole Tenancy Instance Core running in Iowa",
    "Compute optimized Core",
    "Nvidia Tesla T4 GPU running in Iowa",
    "GPU attached in Iowa",
    "SSD backed PD Capacity in Iowa",
    "Regional Storage PD Capacity in Iowa",
    "External IP Charge on a Standard VM",
    "Licensing Fee for X (CPU cost)",
    "Licensing Fee for X on VM with up to 4 VCPU",
    "Licensing Fee for X on VM with 1 to 4 VCPU",
    "Licensing Fee for X on VM with 6 or more VCPU",
    "Licensing Fee for X on VM with 2 VCPU",
    "Licensing Fee for X on f1-micro",
    "Licensing Fee for X on VM with 2 to 8 GPU",
    "Licensing Fee for X (GPU cost)",
    "Licensing Fee for X (RAM cost)",
    "Licensing Fee for Windows Server Core (CPU cost)",
]


@pytest.fixture(scope="module")
def export(spark):
    def sku(i, text, service="Compute Engine", regions=("us-east1", "us-west1"), tiers=(0.5, 0.25)):
        return ((str(i), text), (service,), (list(regions),), ([(t,) for t in tiers],), "HOUR")

    rows = [sku(i, d) for i, d in enumerate(DESCRIPTIONS)]
    rows.append(sku(90, DESCRIPTIONS[0], tiers=()))
    rows.append(sku(91, DESCRIPTIONS[0], regions=()))
    rows.append(sku(92, DESCRIPTIONS[0], service="Cloud Storage"))
    rows.append(sku(93, DESCRIPTIONS[10], regions=()))
    return spark.createDataFrame(rows, schemas.SKU_EXPORT).cache()


def got(df, *cols):
    return {(DESCRIPTIONS[int(r["sku_id"])] if int(r["sku_id"]) < 90 else r["sku_id"],) + tuple(r[c] for c in cols)
            for r in df.collect()}


def test_cpu(export):
    assert got(P.cpu_pricing(export), "cpu", "preemptible") == {
        (DESCRIPTIONS[0], "N1 Predefined Instance Core", False),
        (DESCRIPTIONS[1], "N1 Predefined Instance Core", True),
        (DESCRIPTIONS[5], None, False),
        (DESCRIPTIONS[20], None, False),
    }


def test_ram(export):
    # the license SKU names RAM but neither Instance, Core nor Ram
    assert got(P.ram_pricing(export), "cpu") == {(DESCRIPTIONS[2], "N1 Predefined Instance Ram")}


def test_gpu(export):
    assert got(P.gpu_pricing(export), "gpu") == {
        (DESCRIPTIONS[6], "Nvidia Tesla T4"), (DESCRIPTIONS[7], None), (DESCRIPTIONS[17], None), (DESCRIPTIONS[18], None)}


def test_pd(export):
    assert got(P.pd_pricing(export), "pd", "is_regional") == {
        (DESCRIPTIONS[8], "SSD backed PD Capacity", False), (DESCRIPTIONS[9], "Storage PD Capacity", True)}


def test_ip_ignores_regions(export):
    assert got(P.ip_pricing(export), "ip_key") == {
        (DESCRIPTIONS[10], "External IP Charge"), ("93", "External IP Charge")}


def test_cpu_licenses(export):
    assert got(P.cpu_lic_pricing(export), "lic_key", "machine_class", "min_cpu", "max_cpu") == {
        (DESCRIPTIONS[11], "X", None, None, None),
        (DESCRIPTIONS[12], "X", None, None, 4),
        (DESCRIPTIONS[13], "X", None, 1, 4),
        (DESCRIPTIONS[14], "X", None, 6, None),
        (DESCRIPTIONS[15], "X", None, 2, 2),
        (DESCRIPTIONS[16], "X", "f1-micro", None, None),
        (DESCRIPTIONS[20], "Windows Server Core", None, None, None),
    }


def test_gpu_and_ram_licenses(export):
    assert got(P.gpu_lic_pricing(export), "lic_key", "min_gpu", "max_gpu") == {
        (DESCRIPTIONS[17], "X", 2, 8), (DESCRIPTIONS[18], "X", None, None)}
    assert got(P.ram_lic_pricing(export), "lic_key") == {(DESCRIPTIONS[19], "X")}


def test_tiers_collapse_per_region(export):
    rows = P.cpu_pricing(export).where(F.col("sku_id") == "0").collect()
    assert {(r["region"], r["max_usd"], r["min_usd"]) for r in rows} == {
        ("us-east1", 0.5, 0.25), ("us-west1", 0.5, 0.25)}


def test_build_runs_chosen_steps_and_replaces(export, tmp_path):
    with pytest.raises(ValueError):
        build_price_tables(export, ["build_cpu_pricing", "build_nothing"])
    target = str(tmp_path / "prices")
    for _ in range(2):
        tables = build_price_tables(export, ["build_pd_pricing", "build_ip_pricing"], target)
    assert list(tables) == ["pd", "ip"]
    assert tables["pd"].count() == 4
    assert tables["ip"].count() == 2
