"""Site features of neighbours that arrive over time: the grouped sums are the state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from facetry.operators.sites import structure_tensors


def running_tensors(neighbours: DataFrame, keys: list[str], path: str, checkpoint: str, **trigger):
    """Start a stream that keeps the current structure tensor of each site in the Parquet folder ``path``.

    neighbours: a streaming relation (keys, x, y, z). Each batch replaces the table of changed sites
    ``batch=<id>``; the latest batch of a site is its tensor. ``trigger`` goes to the writer.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    tensors = structure_tensors(neighbours, keys)
    return tensors.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
