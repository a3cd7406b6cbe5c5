"""Schemas of the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyforge import constants as C

_STR, _LONG, _DBL, _BOOL, _TS = (
    T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType())


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SKU_EXPORT = _schema(
    sku=_schema(id=_STR, description=_STR),
    service=_schema(description=_STR),
    geo_taxonomy=_schema(regions=T.ArrayType(_STR)),
    billing_account_price=_schema(tiered_rates=T.ArrayType(_schema(usd_amount=_DBL))),
    pricing_unit=_STR,
)

BILLING_EXPORT = _schema(
    project=_schema(id=_STR, name=_STR),
    service=_schema(description=_STR),
    sku=_schema(id=_STR, description=_STR),
    cost=_DBL,
    usage=_schema(amount=_DBL, unit=_STR),
    invoice=_schema(month=_STR),
    usage_start_time=_TS,
    usage_end_time=_TS,
    export_time=_TS,
    export_date=T.DateType(),
)

ACCELERATORS = T.ArrayType(_schema(count=T.IntegerType(), zone=_STR, type=_STR))

_PAGE_WARNING = _schema(code=_STR)

VM_PAGE = _schema(items=T.MapType(_STR, _schema(
    warning=_PAGE_WARNING,
    instances=T.ArrayType(_schema(
        id=_STR,
        name=_STR,
        status=_STR,
        creationTimestamp=_STR,
        lastStartTimestamp=_STR,
        lastStopTimestamp=_STR,
        machineType=_STR,
        disks=T.ArrayType(_schema(diskSizeGb=_STR, kind=_STR, licenses=T.ArrayType(_STR))),
        scheduling=_schema(preemptible=_BOOL),
        guestAccelerators=T.ArrayType(_schema(acceleratorType=_STR, acceleratorCount=T.IntegerType())),
    )),
)))

DISK_PAGE = _schema(items=T.MapType(_STR, _schema(
    warning=_PAGE_WARNING,
    disks=T.ArrayType(_schema(
        id=_STR,
        name=_STR,
        creationTimestamp=_STR,
        sizeGb=_STR,
        type=_STR,
        region=_STR,
        replicaZones=T.ArrayType(_STR),
    )),
)))

BUDGET_MESSAGE = _schema(
    costAmount=_DBL, budgetAmount=_DBL, budgetDisplayName=_STR, costIntervalStart=_STR)


def _mapping(required: dict[str, T.DataType], optional: dict[str, T.DataType]) -> T.StructType:
    return T.StructType(
        [T.StructField(n, t, False) for n, t in required.items()]
        + [T.StructField(n, t, True) for n, t in optional.items()])


CPU_MAPPING = _mapping(
    {"machine_key": _STR, "cpu": _STR, "cpus_per_core": _LONG}, {"ram": _STR})
GPU_MAPPING = _mapping({"gpu_key": _STR, "gpu": _STR}, {})
PD_MAPPING = _mapping({"pd_key": _STR, "pd": _STR}, {})
LICENSE_MAPPING = _mapping({"vm_lic_key": _STR, "vm_license": _STR}, {"confidence": _STR})

MAPPINGS = {
    "machine_key_to_cpu": (CPU_MAPPING, C.CPU_MAPPING_CSV),
    "gpu_key_to_gpu": (GPU_MAPPING, C.GPU_MAPPING_CSV),
    "pd_key_to_pd": (PD_MAPPING, C.PD_MAPPING_CSV),
    "lic_key_to_lic": (LICENSE_MAPPING, C.LICENSE_MAPPING_CSV),
}


def shipped_mapping(spark: SparkSession, name: str) -> DataFrame:
    """One of the four shipped mapping tables.

    An inline table is a local relation whose size Catalyst knows exactly, so
    joins with it are broadcast without a hint.
    """
    schema, text = MAPPINGS[name]
    rows = ", ".join(
        "(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in C.csv_rows(text))
    columns = ", ".join(f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema)
    return spark.sql(f"SELECT {columns} FROM VALUES {rows} AS m({', '.join(schema.names)})")
