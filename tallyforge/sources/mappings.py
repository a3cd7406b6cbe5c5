"""Mapping tables: headerless CSV with a declared schema."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "STRING": T.StringType(),
    "INT64": T.LongType(),
    "INTEGER": T.LongType(),
    "FLOAT64": T.DoubleType(),
    "FLOAT": T.DoubleType(),
    "BOOL": T.BooleanType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
}


def declared_schema(definition: list[dict] | str | Path) -> T.StructType:
    """Schema from a field list (name, type, mode) or the JSON file holding one."""
    if not isinstance(definition, list):
        definition = json.loads(Path(definition).read_text())
    return T.StructType([
        T.StructField(f["name"], _TYPES[f["type"].upper()], f.get("mode", "NULLABLE").upper() != "REQUIRED",
                      {"comment": f.get("description", "")})
        for f in definition
    ])


def load_mapping(
    spark: SparkSession,
    path: str,
    schema: T.StructType | list[dict] | str | Path,
    table: str | None = None,
) -> DataFrame:
    """Load a headerless CSV; a missing value in a REQUIRED column fails the load.

    The reader ignores nullability, so the check is part of the plan: every
    required column is read through ``raise_error`` on NULL. With ``table`` the
    target is replaced and read back.
    """
    if not isinstance(schema, T.StructType):
        schema = declared_schema(schema)
    raw = spark.read.schema(schema).option("header", False).option("mode", "FAILFAST").csv(path)
    df = raw.select([_checked(f).alias(f.name) for f in schema])
    if table is None:
        return df
    df.write.mode("overwrite").saveAsTable(table)
    return spark.table(table)


def _checked(field: T.StructField) -> Column:
    c = F.col(field.name)
    if field.nullable:
        return c
    failure = F.raise_error(F.lit(f"REQUIRED column {field.name} is empty")).cast(field.dataType)
    return F.when(c.isNull(), failure).otherwise(c)
