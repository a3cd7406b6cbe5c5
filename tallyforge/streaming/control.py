"""The controller driven by budget messages: one run per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tallyforge.streaming.alerts import current_spend, stream_cumulative_spend


def stream_control(alerts: DataFrame, state_path: str, checkpoint: str,
                   decide: Callable[[DataFrame, int], object], once: bool = True) -> StreamingQuery:
    """Bring each batch of messages into the spend table, then decide on all projects.

    ``decide(spend, batch_id)`` is usually ``control_run`` with ``spend`` and
    ``run`` filled in. Both steps replace what a failed attempt left.
    """
    spark = alerts.sparkSession
    return stream_cumulative_spend(alerts, state_path, checkpoint, once,
                                   after=lambda batch_id: decide(current_spend(spark, state_path), batch_id))
