"""Mutations from a stream: each micro-batch is one batch of the store, then a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from terrace.operators.store import NestedStore


def feed(stream: DataFrame, layer: str, root: str, checkpoint: str) -> StreamingQuery:
    """stream: operations on one layer (its columns, ``seq`` and ``op``). Ends when all that is there has been applied.
    Each version tells the last batch that it took from this checkpoint, so a batch that is tried again after its version
    was marked is passed over. A checkpoint folder that starts anew needs a name of its own."""

    def one(batch: DataFrame, number: int) -> None:
        apply_once(batch, layer, root, checkpoint, number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_once(batch: DataFrame, layer: str, root: str, source: str, number: int) -> bool:
    """Applies a batch unless its source's batch of this number, or a later one, is in the store."""
    spark = batch.sparkSession
    store = NestedStore.open(spark, root)
    if number <= store.applied.get(source, -1):
        return False
    store.apply({layer: batch}).save(spark, root, {source: number})
    return True
