"""Incremental corpus ingest: new documents become chunks and vectors as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillvec.operators.chunking import chunk
from quillvec.operators.embedding import BATCH_SIZE, Embedder, embed


def ingest(
    docs: DataFrame,
    out: str,
    checkpoint: str,
    granularity: str = "sentence",
    embedder: Embedder | None = None,
    dim: int | None = None,
    batch_size: int = BATCH_SIZE,
    **options,
) -> StreamingQuery:
    """Append the chunks of a document stream to a Parquet table at ``out``.

    Chunks keep the key ``(doc_id, pos)``; dense ids are given afterwards, over
    the finished table. Takes what is there and stops; run it again for more.
    """
    chunks = chunk(docs, granularity, **options)
    if embedder is not None:
        chunks = embed(chunks, embedder, dim, batch_size)
    return (
        chunks.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
