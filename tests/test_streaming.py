import pytest
from pyspark.sql import functions as F

from quillvec.operators.chunking import chunk
from quillvec.operators.embedding import embed, hashed_words
from quillvec.plans import corpus_queries
from quillvec.streaming.ingest import ingest
from quillvec.streaming.snapshots import keep_latest, latest_snapshots

DOCS = "doc_id long, text string"


def write(spark, path, ids):
    rows = [(i, f"Sentence one of document {i}. Sentence two of document {i}.") for i in ids]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(path)


def test_documents_arriving_in_parts_equal_one_batch(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for ids in (range(0, 30), range(30, 45)):
        write(spark, inbox, ids)
        arriving = spark.readStream.schema(DOCS).parquet(inbox)
        ingest(arriving, out, state, embedder=hashed_words(16), dim=16).awaitTermination()
    streamed = spark.read.parquet(out)
    batch = embed(chunk(spark.read.parquet(inbox), "sentence"), hashed_words(16), 16)
    key = lambda r: (r.doc_id, r.pos)
    assert sorted(streamed.collect(), key=key) == sorted(batch.collect(), key=key)
    assert streamed.count() == 90


@pytest.mark.parametrize("query", ["stream_equals_batch", "stream_embed"])
def test_table_in_a_folder_streams_like_a_file(spark, sf_dir, tmp_path, query):
    stream = corpus_queries.QUERIES[query]
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    whole, parted = stream(spark, sf_dir), stream(spark, str(tmp_path))
    assert whole.count() > 0
    assert sorted(parted.collect()) == sorted(whole.collect())


def test_latest_push_per_shard_wins_whatever_the_order(spark, tmp_path):
    inbox, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    schema = "qid long, shard int, seq int, hits array<struct<id: bigint, score: double>>"
    for pushes in ([(0, 0, 5, [(1, 0.5)]), (0, 1, 0, [(2, 0.4)])], [(0, 0, 3, [(7, 0.9)])],
                   [(0, 1, 1, [])]):
        spark.createDataFrame(pushes, schema).coalesce(1).write.mode("append").parquet(inbox)
        arriving = spark.readStream.schema(schema).parquet(inbox)
        keep_latest(arriving, table, state).awaitTermination()
    latest = latest_snapshots(spark.read.parquet(table))
    got = {r.shard: (r.seq, [tuple(h) for h in r.hits]) for r in latest.collect()}
    assert got == {0: (5, [(1, 0.5)]), 1: (1, [])}
    assert latest.where(F.col("qid") == 0).count() == 2
