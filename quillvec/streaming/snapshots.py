"""Latest shard snapshots from a stream of pushes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def keep_latest(pushes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write every changed ``(qid, shard)`` slot to ``table``.

    ``pushes`` is a stream of ``(qid, shard, seq, hits)``. State is one snapshot
    per slot. Each micro-batch replaces its own folder, so a repeated batch has
    no effect; ``latest_snapshots`` reads the table back.
    """
    slots = pushes.groupBy("qid", "shard").agg(
        F.max("seq").alias("seq"), F.max_by("hits", "seq").alias("hits")
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (
        slots.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_snapshots(table: DataFrame) -> DataFrame:
    """The last snapshot of every slot."""
    return table.groupBy("qid", "shard").agg(
        F.max("seq").alias("seq"), F.max_by("hits", "seq").alias("hits")
    )
