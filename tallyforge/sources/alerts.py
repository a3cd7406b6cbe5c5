"""Budget alert messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions.keys import parse_rfc3339


def decode_budget_alerts(messages: DataFrame, data: str = "data") -> DataFrame:
    """Base64 JSON payloads to columns; works on batch and streaming input.

    The project is the budget name without ``-budget``. Other columns of
    ``messages`` (event time, message id) are kept. Messages that cannot be
    decoded are left out; ``rejected_budget_alerts`` has them.
    """
    kept = [c for c in messages.columns if c != data]
    return _decoded(messages, data).where("_reason IS NULL").select(*kept, "project_id", "interval_start", "cost", "budget")


def rejected_budget_alerts(messages: DataFrame, data: str = "data") -> DataFrame:
    """Messages that cannot be decoded, as they came, with ``reason``."""
    return _decoded(messages, data).where("_reason IS NOT NULL").select(*messages.columns, F.col("_reason").alias("reason"))


def _decoded(messages: DataFrame, data: str) -> DataFrame:
    """Payload columns next to the raw message; ``_reason`` is NULL where everything is there."""
    text = F.try_validate_utf8(F.try_to_binary(data, F.lit("base64")).cast("string"))
    # a generator is not repeated where its columns are used, so each payload is decoded and parsed once
    parsed = F.transform(F.array(text), lambda t: F.struct(
        t.alias("_text"), F.from_json(t, schemas.BUDGET_MESSAGE, {"mode": "PERMISSIVE"}).alias("_m")))
    rows = messages.select(*messages.columns, F.inline_outer(parsed)).select(
        *messages.columns, "_text",
        F.replace(F.col("_m.budgetDisplayName"), F.lit("-budget"), F.lit("")).alias("project_id"),
        parse_rfc3339("_m.costIntervalStart", strict=False).alias("interval_start"),
        F.col("_m.costAmount").alias("cost"),
        F.col("_m.budgetAmount").alias("budget"),
    )
    required = ("project_id", "interval_start", "cost", "budget")
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    reason = (F.when(F.col("_text").isNull(), "not base64 text")
              .when(F.coalesce(*[F.col(c).cast("string") for c in required]).isNull(), "not a budget document")
              .when(missing != "", F.concat(F.lit("missing or malformed: "), missing)))
    return rows.withColumn("_reason", reason)
