"""Price lookups.

Machines share few distinct lookup keys, so the answers form a small *rate
card*: prices are reduced to one row per lookup key before they meet any
machine, the card is settled as a small written table, and machines join it
once. Hot keys (everybody runs the same machine type) cost nothing, because
the machine side is not shuffled while the card is below the broadcast
threshold, and price rows are pre-aggregated before they are shuffled at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.keys import (
    disk_region, machine_key, memory_gb, num_gpu, region_of_zone, special_class)
from tallyforge.session import settle

_CHOICE = ("sku_id", "max_usd", "min_usd", "pricing_unit")


def one_price(matches: DataFrame, keys: list[str], mode: str = "first") -> DataFrame:
    """One match per key: the dearest, then the smallest SKU id; ``n_matches`` counts all.

    It combines: reducing reduced matches again gives the same answer, so it can
    run before and after a join. ``mode='strict'`` fails on a key with several.
    """
    if mode not in ("first", "strict"):
        raise ValueError(f"mode must be 'first' or 'strict', not {mode!r}")
    weight = F.col("n_matches") if "n_matches" in matches.columns else F.lit(1)
    rest = [c for c in matches.columns if c not in (*keys, *_CHOICE, "n_matches")]
    order = F.coalesce(-F.col("max_usd"), F.lit(float("inf")))
    ranked = F.struct(order.alias("_o"), *_CHOICE, *rest)
    n = F.sum(weight.cast("bigint"))
    best = matches.groupBy(*keys).agg(F.min(ranked).alias("_b"), n.alias("n_matches"))
    if mode == "strict":
        too_many = F.raise_error(F.concat(
            F.lit("too many prices for "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys])))
        best = best.withColumn("n_matches", F.when(F.col("n_matches") > 1, too_many.cast("bigint"))
                               .otherwise(F.col("n_matches")))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in (*_CHOICE, *rest)], "n_matches")


def vm_card(cpu_prices: DataFrame, ram_prices: DataFrame, cpu_map: DataFrame, mode: str = "first") -> DataFrame:
    """Core and memory price per (machine_key, region, preemptible).

    Memory follows the left-join-then-filter rule: a machine type without a
    memory key, or whose key is in no memory row at all, stays with NULL; one
    whose key is priced only elsewhere is dropped.
    """
    where = ["region", "preemptible"]
    # one_price keeps cpu apart from the mapping, so it runs on price rows before any join
    cpu = one_price(cpu_prices.where(F.col("cpu").isNotNull()), ["cpu", *where])
    ram = one_price(ram_prices.where(F.col("cpu").isNotNull()), ["cpu", *where])
    ram = ram.select(
        F.col("cpu").alias("ram"), *where,
        *[F.col(c).alias(f"ram_{c}") for c in _CHOICE], F.col("n_matches").alias("_n_ram"))
    known_ram = ram.select("ram").distinct().withColumn("_ram_known", F.lit(True))
    cpu = cpu.select("cpu", *where, *[F.col(c).alias(f"cpu_{c}") for c in _CHOICE],
                     F.col("n_matches").alias("_n_cpu"))
    joined = cpu_map.join(cpu, "cpu").join(ram, ["ram", *where], "left").join(known_ram, "ram", "left")
    kept = joined.where(F.col("_n_ram").isNotNull() | F.col("_ram_known").isNull())
    n = F.col("_n_cpu") * F.coalesce("_n_ram", F.lit(1))
    if mode == "strict":
        n = F.when(n > 1, F.raise_error(F.concat(
            F.lit("too many prices for "), F.col("machine_key"))).cast("bigint")).otherwise(n)
    return kept.select(
        "machine_key", *where, "cpu", "ram", "cpus_per_core",
        *[f"cpu_{c}" for c in _CHOICE], *[f"ram_{c}" for c in _CHOICE], n.alias("n_matches"))


def gpu_card(gpu_prices: DataFrame, gpu_map: DataFrame, mode: str = "first") -> DataFrame:
    """Price per (gpu_key, region, preemptible)."""
    priced = one_price(gpu_prices.where(F.col("gpu").isNotNull()), ["gpu", "region", "preemptible"])
    return one_price(gpu_map.join(priced, "gpu").drop("gpu"), ["gpu_key", "region", "preemptible"], mode)


def pd_card(pd_prices: DataFrame, pd_map: DataFrame, mode: str = "first") -> DataFrame:
    """Price per (pd_key, region, is_regional)."""
    priced = one_price(pd_prices.where(F.col("pd").isNotNull()), ["pd", "region", "is_regional"])
    return one_price(pd_map.join(priced, "pd").drop("pd"), ["pd_key", "region", "is_regional"], mode)


def ram_lic_card(lic_prices: DataFrame, lic_map: DataFrame, mode: str = "first") -> DataFrame:
    """Price per license."""
    priced = one_price(lic_prices.where(F.col("lic_key").isNotNull()), ["lic_key"])
    by_license = lic_map.join(priced, F.col("vm_license") == F.col("lic_key"))
    return one_price(by_license.drop("vm_license", "lic_key", "confidence")
                     .withColumnRenamed("vm_lic_key", "license"), ["license"], mode)


def _band_card(lic_prices: DataFrame, lic_map: DataFrame, wanted: DataFrame, unit: str,
               classes: bool, mode: str) -> DataFrame:
    """Price per wanted (license, units[, special_class]), units inside the open-ended band.

    Bands are reduced to one row per (license, bounds) first, so the band join
    sees distinct bands against distinct wanted keys, never machines or SKUs.
    """
    low, high = f"min_{unit}", f"max_{unit}"
    band = ["lic_key", low, high, *(["machine_class"] if classes else [])]
    bands = one_price(lic_prices.where(F.col("lic_key").isNotNull()), band)
    bands = lic_map.select(F.col("vm_lic_key").alias("license"), "vm_license").join(
        bands, F.col("vm_license") == F.col("lic_key"))
    keys = ["license", unit, *(["special_class"] if classes else [])]
    want = wanted.select(*keys).distinct()
    inside = ((F.col(high).isNull() | (F.col(high) >= F.col(unit)))
              & (F.col(low).isNull() | (F.col(low) <= F.col(unit)))
              & (want["license"] == bands["license"]))
    if classes:
        inside = inside & F.col("machine_class").eqNullSafe(F.col("special_class"))
    matched = want.join(bands, inside).select(want["license"], *keys[1:], *_CHOICE, "n_matches")
    return one_price(matched, keys, mode)


def cpu_lic_card(lic_prices: DataFrame, lic_map: DataFrame, wanted: DataFrame, mode: str = "first") -> DataFrame:
    """Price per (license, cpus, special_class); machine class must agree, NULL with NULL."""
    prices = lic_prices.withColumnsRenamed({"min_cpu": "min_cpus", "max_cpu": "max_cpus"})
    return _band_card(prices, lic_map, wanted, "cpus", True, mode)


def gpu_lic_card(lic_prices: DataFrame, lic_map: DataFrame, wanted: DataFrame, mode: str = "first") -> DataFrame:
    """Price per (license, num_gpu) for machines with accelerators."""
    prices = lic_prices.withColumnsRenamed({"min_gpu": "min_num_gpu", "max_gpu": "max_num_gpu"})
    return _band_card(prices, lic_map, wanted.where("num_gpu > 0"), "num_gpu", False, mode)


def _vm_keys(vms: DataFrame, *extra: Column) -> DataFrame:
    return vms.select("project_id", "vm_id", *extra)


def _match(left: DataFrame, card: DataFrame, keys: list[str], null_safe: tuple[str, ...] = ()) -> DataFrame:
    on = reduce(Column.__and__, [
        left[k].eqNullSafe(card[k]) if k in null_safe else left[k] == card[k] for k in keys])
    return left.join(card, on).select(*[left[c] for c in left.columns],
                                      *[card[c] for c in card.columns if c not in keys])


def vm_price_lookup(vms: DataFrame, cpu_prices: DataFrame, ram_prices: DataFrame, cpu_map: DataFrame,
                    mode: str = "first") -> DataFrame:
    """Core and memory price of every VM that has one."""
    card = settle(vm_card(cpu_prices, ram_prices, cpu_map, mode), "vm-card")
    keyed = _vm_keys(vms, machine_key("machine_type").alias("machine_key"),
                     region_of_zone("zone").alias("region"), F.col("preemptible"))
    return _match(keyed, card, ["machine_key", "region", "preemptible"])


def gpu_price_lookup(vms: DataFrame, gpu_prices: DataFrame, gpu_map: DataFrame, mode: str = "first") -> DataFrame:
    """Price of every accelerator entry."""
    card = settle(gpu_card(gpu_prices, gpu_map, mode), "gpu-card")
    entries = vms.select(
        "project_id", "vm_id", region_of_zone("zone").alias("region"), "preemptible",
        F.posexplode("accel").alias("entry", "_a"))
    keyed = entries.select("project_id", "vm_id", "entry", F.col("_a.type").alias("gpu_key"),
                           F.col("_a.count").alias("gpu_count"), "region", "preemptible")
    return _match(keyed, card, ["gpu_key", "region", "preemptible"])


def pd_price_lookup(disks: DataFrame, pd_prices: DataFrame, pd_map: DataFrame, mode: str = "first") -> DataFrame:
    """Price of every disk."""
    card = settle(pd_card(pd_prices, pd_map, mode), "pd-card")
    keyed = disks.select("project_id", "disk_id", F.col("type").alias("pd_key"),
                         disk_region("is_regional", "disk_region", "zone").alias("region"), "is_regional")
    return _match(keyed, card, ["pd_key", "region", "is_regional"])


def _license_columns(vms: DataFrame) -> DataFrame:
    return vms.select("project_id", "vm_id", "license", "cpus",
                      special_class("machine_type").alias("special_class"),
                      num_gpu("accel").alias("num_gpu"))


def cpu_lic_lookup(vms: DataFrame, lic_prices: DataFrame, lic_map: DataFrame, mode: str = "first") -> DataFrame:
    """CPU-count dependent license price of every VM."""
    keyed = _license_columns(vms).drop("num_gpu")
    card = settle(cpu_lic_card(lic_prices, lic_map, keyed, mode), "cpu-lic-card")
    return _match(keyed, card, ["license", "cpus", "special_class"], null_safe=("special_class",))


def gpu_lic_lookup(vms: DataFrame, lic_prices: DataFrame, lic_map: DataFrame, mode: str = "first") -> DataFrame:
    """Accelerator-count dependent license price of every VM with accelerators."""
    keyed = _license_columns(vms).drop("cpus", "special_class").where("num_gpu > 0")
    card = settle(gpu_lic_card(lic_prices, lic_map, keyed, mode), "gpu-lic-card")
    return _match(keyed, card, ["license", "num_gpu"])


def ram_lic_lookup(vms: DataFrame, lic_prices: DataFrame, lic_map: DataFrame, mode: str = "first") -> DataFrame:
    """Memory dependent license price of every VM."""
    card = settle(ram_lic_card(lic_prices, lic_map, mode), "ram-lic-card")
    return _match(_vm_keys(vms, F.col("license")), card, ["license"])


# --- all components at once -------------------------------------------------

_REQUEST = "request_key"


def _request_key(*parts: Column | str) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def vm_requests(vms: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every price a VM needs, one row each, from one pass over the VMs.

    ``part`` is vm, gpu, cpu_lic, gpu_lic or ram_lic; ``quantity`` is what the
    rate will be multiplied by (cores and memory are filled in by ``vm_skus``).
    Columns named in ``carry`` ride along, which saves joining them back later.
    """
    base = vms.select(
        "project_id", "vm_id", *carry, "cpus", memory_gb("memory_mb").alias("memory_gb"), "license", "preemptible",
        "accel", machine_key("machine_type").alias("machine_key"), region_of_zone("zone").alias("region"),
        special_class("machine_type").alias("special_class"), num_gpu("accel").alias("num_gpu"))

    def request(part: str, key: Column, quantity: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), key.alias(_REQUEST),
                        quantity.cast("double").alias("quantity"))

    fixed = F.array(
        request("vm", _request_key(F.lit("vm"), "machine_key", "region", "preemptible"), F.lit(None)),
        request("cpu_lic", _request_key(F.lit("cpu_lic"), "license", "cpus", "special_class"), F.lit(1)),
        request("ram_lic", _request_key(F.lit("ram_lic"), "license"), F.col("memory_gb")),
    )
    gpus = F.transform(F.coalesce("accel", F.array()), lambda a: request(
        "gpu", _request_key(F.lit("gpu"), a["type"], "region", "preemptible"), a["count"]))
    gpu_lic = F.when(F.col("num_gpu") > 0, F.array(request(
        "gpu_lic", _request_key(F.lit("gpu_lic"), "license", "num_gpu"), F.lit(1))))
    requests = F.concat(fixed, gpus, F.coalesce(gpu_lic, F.slice(fixed, 1, 0)))
    kept = ["project_id", "vm_id", *carry, "cpus", "memory_gb"]
    return base.select(*kept, F.explode(requests).alias("_r")).select(*kept, "_r.*")


def _card_rows(card: DataFrame, component: str, key: Column) -> DataFrame:
    return card.select(
        key.alias(_REQUEST), F.lit(component).alias("component"), "sku_id", F.col("max_usd").alias("rate"),
        F.col("pricing_unit").alias("unit"), F.lit(None).cast("bigint").alias("cpus_per_core"), "n_matches")


def price_cards(prices: dict[str, DataFrame], mappings: dict[str, DataFrame], mode: str = "first") -> DataFrame:
    """The cards that depend on prices and mappings alone, to be written next to the price tables."""
    vm = vm_card(prices["cpu"], prices["ram"], mappings["machine_key_to_cpu"], mode)

    def of(component: str, per_core: Column) -> Column:
        return F.struct(F.lit(component).alias("component"), F.col(f"{component}_sku_id").alias("sku_id"),
                        F.col(f"{component}_max_usd").alias("rate"), F.col(f"{component}_pricing_unit").alias("unit"),
                        per_core.cast("bigint").alias("cpus_per_core"))

    machines = vm.select(_request_key(F.lit("vm"), "machine_key", "region", "preemptible").alias(_REQUEST),
                         F.inline(F.array(of("cpu", F.col("cpus_per_core")), of("ram", F.lit(None)))), "n_matches")
    gpus = _card_rows(gpu_card(prices["gpu"], mappings["gpu_key_to_gpu"], mode), "gpu",
                      _request_key(F.lit("gpu"), "gpu_key", "region", "preemptible"))
    memory = _card_rows(ram_lic_card(prices["ram_lic"], mappings["lic_key_to_lic"], mode), "ram_lic",
                        _request_key(F.lit("ram_lic"), "license"))
    return machines.unionByName(gpus).unionByName(memory)


def rate_card(vms: DataFrame, prices: dict[str, DataFrame], mappings: dict[str, DataFrame],
              mode: str = "first", fixed: DataFrame | None = None) -> DataFrame:
    """All cards under one request key, settled: (request_key, component, sku_id, rate, unit, ...).

    ``fixed`` is ``price_cards`` as written with the price tables; only the two
    license bands, which need the machines' sizes, are made here then.
    """
    lic_map = mappings["lic_key_to_lic"]
    keyed = _license_columns(vms)
    wanted = keyed.select("license", "cpus", "special_class", "num_gpu").distinct()
    bands = [
        _card_rows(cpu_lic_card(prices["cpu_lic"], lic_map, wanted, mode), "cpu_lic",
                   _request_key(F.lit("cpu_lic"), "license", "cpus", "special_class")),
        _card_rows(gpu_lic_card(prices["gpu_lic"], lic_map, wanted, mode), "gpu_lic",
                   _request_key(F.lit("gpu_lic"), "license", "num_gpu")),
    ]
    if fixed is None:
        fixed = price_cards(prices, mappings, mode)
    return settle(reduce(DataFrame.unionByName, bands, fixed), "rate-card")


def vm_skus(vms: DataFrame, card: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per VM and priced component: SKU, rate, unit and quantity.

    A machine without a memory price gets a ram row with NULL SKU and rate.
    """
    quantity = (F.when(F.col("component") == "cpu", F.col("cpus") / F.col("cpus_per_core"))
                .when(F.col("component") == "ram", F.col("memory_gb"))
                .otherwise(F.col("quantity")))
    return vm_requests(vms, carry).join(card, _REQUEST).select(
        "project_id", "vm_id", *carry, "component", "sku_id", "rate", "unit", quantity.alias("quantity"), "n_matches")


def disk_skus(disks: DataFrame, pd_prices: DataFrame, pd_map: DataFrame, mode: str = "first",
              carry: tuple[str, ...] = (), card: DataFrame | None = None) -> DataFrame:
    """One row per priced disk: SKU, rate, unit and size. ``card`` is a ``pd_card`` written before."""
    if card is None:
        card = settle(pd_card(pd_prices, pd_map, mode), "pd-card")
    keyed = disks.select("project_id", "disk_id", *carry, F.col("size_gb").cast("double").alias("quantity"),
                         F.col("type").alias("pd_key"),
                         disk_region("is_regional", "disk_region", "zone").alias("region"), "is_regional")
    priced = _match(keyed, card, ["pd_key", "region", "is_regional"])
    return priced.select("project_id", "disk_id", *carry, F.lit("disk").alias("component"), "sku_id",
                         F.col("max_usd").alias("rate"), F.col("pricing_unit").alias("unit"),
                         "quantity", "n_matches")


def unpriced_resources(vms: DataFrame, card: DataFrame) -> DataFrame:
    """Requests of VMs that no price answers."""
    return (vm_requests(vms).join(card.select(_REQUEST).distinct(), _REQUEST, "left_anti")
            .select("project_id", F.col("vm_id").alias("resource_id"), F.col("part").alias("missing"), _REQUEST))


def unpriced_disks(disks: DataFrame, pd_prices: DataFrame, pd_map: DataFrame, card: DataFrame | None = None) -> DataFrame:
    """Disks that no price answers."""
    if card is None:
        card = settle(pd_card(pd_prices, pd_map), "pd-card")
    card = card.select("pd_key", "region", "is_regional")
    keyed = disks.select("project_id", F.col("disk_id").alias("resource_id"), F.col("type").alias("pd_key"),
                         disk_region("is_regional", "disk_region", "zone").alias("region"), "is_regional")
    return keyed.join(card, ["pd_key", "region", "is_regional"], "left_anti").select(
        "project_id", "resource_id", F.lit("disk").alias("missing"),
        _request_key(F.lit("disk"), "pd_key", "region", "is_regional").alias(_REQUEST))
