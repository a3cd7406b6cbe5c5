"""Starting stateful streams and keeping state tables current by them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from tallyforge.sources.state import StateTable, save_state

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Combined rows that a task holds before it passes them on.
HELD = 200_000


def combined(batches: Iterator[pa.RecordBatch], combine: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """What ``combine`` leaves of a task's rows, over all its batches while few rows are left of them.

    ``combine`` must give the same when parts are combined first. Where keys are many, held rows go on and others are begun.
    """
    held: list[pa.Table] = []
    for batch in batches:
        held.append(combine(pa.Table.from_batches([batch])))
        if sum(t.num_rows for t in held) >= HELD:
            held = [combine(pa.concat_tables(held))]
            if held[0].num_rows >= HELD // 2:
                yield from held.pop().to_batches()
    if held:
        yield from combine(pa.concat_tables(held)).to_batches()


def start(changes: DataFrame, checkpoint: str, store: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Run ``store`` on every batch of a stateful stream; ``once`` processes what is there and stops.

    State is in RocksDB, and a batch uploads what it changed, not all there is.
    """
    conf = changes.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if once else writer).start()


def keep_state(changes: DataFrame, state: StateTable, checkpoint: str, once: bool = True, removed: Column | None = None,
               after: Callable[[int], object] | None = None) -> StreamingQuery:
    """Bring the whole values of the keys that each batch changed into ``state``.

    ``after`` is called with the batch number once the batch is in the table. A
    replayed batch has the same values, so it changes nothing.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        save_state(batch, state, removed)
        if after is not None:
            after(batch_id)

    return start(changes, checkpoint, store, once)
