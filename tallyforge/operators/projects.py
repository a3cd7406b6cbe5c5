"""Joins of resources with facts about projects.

One project may own a third of all resources, so a resource is never dealt by
its project alone: rows are spread by a hash of their own id, and the few
project rows are copied to every spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREADS = 16


def join_project(rows: DataFrame, projects: DataFrame, how: str, spread_by: str, spreads: int = SPREADS) -> DataFrame:
    """``rows`` joined with ``projects`` on project_id, spread by the column ``spread_by``."""
    copies = projects.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(spreads - 1))))
    return (rows.withColumn("_spread", F.pmod(F.xxhash64(spread_by), F.lit(spreads)).cast("int"))
            .join(copies, ["project_id", "_spread"], how).drop("_spread"))
