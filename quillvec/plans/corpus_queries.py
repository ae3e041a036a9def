"""Queries on texts: sources, chunking, embedding, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.functions import text as T
from quillvec.operators.chunking import chunk, corpus_profile
from quillvec.operators.embedding import (
    Unavailable,
    embed,
    filled_values,
    hashed_words,
    masked_mean_pool,
    profile_set,
    rows_of,
    with_retry,
)
from quillvec.operators.ids import dense_chunk_ids
from quillvec.operators.search import query_set, top_k, with_text
from quillvec.plans.tables import DIM, documents, longs, messages, rounded, table
from quillvec.session import pin, scratch_path
from quillvec.sources.corpus import (
    first_docs,
    message_lines,
    read_corpus,
    read_jsonl,
    read_messages,
    to_jsonl,
    write_jsonl,
    write_text_dir,
)
from quillvec.streaming.ingest import ingest

# The matrix of embedding sets: two models' dimensions by two granularities.
SETS = tuple((dim, g) for dim in (1024, 384) for g in ("sentence", "paragraph"))
SET_SHARDS = 16
NEAREST = 10
FIRST = 60


def src_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    write_jsonl(table(spark, sf_dir, "documents").orderBy("doc_id"), path)
    docs = read_jsonl(spark, path)
    return docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "text")


def src_jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents among lines that must drop out, and a text that only looks empty."""
    path, kind = scratch_path(spark, "lines"), F.col("doc_id") % 8
    whole = F.to_json(F.struct("text"))
    line = (
        F.when(kind == 0, F.concat(whole, F.lit(" trailing")))
        .when(kind == 1, F.concat(whole, whole))
        .when(kind == 2, '{"text": 0}')
        .when(kind == 3, '{"text": "0"}')
        .when(kind == 4, '{"text": []}')
        .when(kind == 5, "{'text': 'single quotes'}")
        .otherwise(whole)
    )
    table(spark, sf_dir, "documents").orderBy("doc_id").select(line.alias("value")).write.text(path)
    return read_jsonl(spark, path).select("doc_id", "text")


def src_jsonl_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, each beside a line that must drop out."""
    path, kind = scratch_path(spark, "mixed-lines"), F.col("doc_id") % 4
    whole = F.to_json(F.struct("text"))
    broken = (
        F.when(kind == 0, F.concat(whole, F.lit(" trailing")))
        .when(kind == 1, '{"text": 0}')
        .when(kind == 2, "{'text': 'single quotes'}")
        .otherwise("")
    )
    docs = table(spark, sf_dir, "documents").orderBy("doc_id")
    docs.select(F.explode(F.array(whole, broken)).alias("value")).write.text(path)
    return read_jsonl(spark, path).select("doc_id", "text")


def src_jsonl_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents of many files, of which few are read."""
    path = scratch_path(spark, "many-lines")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.repartitionByRange(40, "doc_id").sortWithinPartitions("doc_id").write.json(path)
    return read_jsonl(spark, path, max_docs=FIRST).select("doc_id", "text")


def embed_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors from an embedder that turns every batch down once before it answers."""
    plain, refused = hashed_words(DIM), set()

    def moody(texts: list[str]):
        key = hash(tuple(texts))
        if key not in refused:
            refused.add(key)
            raise Unavailable("busy")
        return plain(texts)

    chunks = chunk(documents(spark, sf_dir), "sentence")
    vecs = embed(chunks, with_retry(moody, first_wait=0.01), DIM)
    flat = rows_of(vecs, "doc_id", "pos").withColumn("value", rounded("value"))
    return longs(flat, "pos", "d")


def src_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "messages")
    messages(spark, sf_dir).orderBy("conv_id", "turn").select("text").write.text(path)
    return read_messages(spark, path)


def src_text_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "texts")
    write_text_dir(documents(spark, sf_dir), path, "doc_id")
    return read_corpus(spark, "text_dir", path).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "text"
    )


def message_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = message_lines(messages(spark, sf_dir).select("conv_id", "turn", "text"))
    return longs(lines.select("conv_id", "turn", "line", "text"), "line")


def corpus_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_jsonl(table(spark, sf_dir, "documents"))


def first_n_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return first_docs(docs.where(~T.is_blank(F.col("text"))), 100)


def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(chunk(documents(spark, sf_dir), "sentence"), "pos")


def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(chunk(documents(spark, sf_dir), "paragraph"), "pos")


def chunk_paragraphs_delim(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk(documents(spark, sf_dir), "paragraph", paragraph_delimiter="\n")
    return longs(chunks, "pos")


def chunk_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.posexplode(T.wrap(T.strip(F.col("text")))).alias("pos", "text")
    return longs(documents(spark, sf_dir).select("doc_id", pieces), "pos")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_profile(documents(spark, sf_dir)).withColumn("avg_chars", rounded("avg_chars"))


def _embedded(docs: DataFrame, granularity: str, dim: int) -> DataFrame:
    return embed(chunk(docs, granularity), with_retry(hashed_words(dim)), dim)


def _numbered(spark: SparkSession, df: DataFrame, id_col: str, label: str) -> DataFrame:
    """Write chunks to a table, then number them from the keys of that table."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return dense_chunk_ids(spark.read.parquet(path), id_col)


def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = _embedded(documents(spark, sf_dir), "sentence", DIM)
    flat = rows_of(vecs, "doc_id", "pos").withColumn("value", rounded("value"))
    return longs(flat, "pos", "d")


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector per document: the mean of its sentences, short ones masked out."""
    chunks = chunk(documents(spark, sf_dir), "sentence").withColumn(
        "mask", (F.length("text") >= 40).cast("int")
    )
    pooled = masked_mean_pool(embed(chunks, hashed_words(DIM), DIM), "doc_id")
    return longs(pooled.withColumn("value", rounded("value")), "pos")


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk(documents(spark, sf_dir), "sentence").select(
        "doc_id", "pos", F.length("text").alias("n_chars")
    )
    numbered = _numbered(spark, chunks, "chunk_id", "chunks")
    return longs(numbered.select("chunk_id", "doc_id", "pos", "n_chars"), "chunk_id", "pos", "n_chars")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = _numbered(spark, _embedded(documents(spark, sf_dir), "paragraph", DIM), "id", "vecs")
    flat = rows_of(query_set(vecs), "qid").withColumn("value", rounded("value"))
    return longs(flat, "qid", "d")


def embedding_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rows = documents(spark, sf_dir), None
    for dim, granularity in SETS:
        path = scratch_path(spark, "set")
        _embedded(docs, granularity, dim).write.parquet(path)
        # Numbering joins rows by document; the vectors stay in the table.
        narrow = spark.read.parquet(path).select("doc_id", "pos", filled_values("embedding").alias("filled"))
        row = profile_set(pin(dense_chunk_ids(pin(narrow), "id")), f"{dim}-{granularity}", granularity, dim, SET_SHARDS, 5000)
        rows = row if rows is None else rows.unionByName(row)
    return rows


def _searched_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = chunk(documents(spark, sf_dir), "paragraph")
    with_copy = docs.withColumn("content", F.col("text"))
    vecs = embed(with_copy, hashed_words(DIM), DIM)
    path = scratch_path(spark, "searched")
    _numbered(spark, vecs, "id", "corpus").write.parquet(path)
    stored = spark.read.parquet(path)
    return stored, top_k(stored, query_set(stored), NEAREST, DIM)


def knn_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: texts, chunks, vectors, the first 5000 as queries, exact top K."""
    _, hits = _searched_corpus(spark, sf_dir)
    return longs(hits.select("qid", "rank", "id", rounded("score", 9).alias("score")), "rank")


def knn_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, hits = _searched_corpus(spark, sf_dir)
    texts = stored.select(F.col("id").alias("chunk_id"), "doc_id", F.col("content").alias("text"))
    return longs(with_text(hits, texts).select("qid", "rank", "id", "doc_id", "text"), "rank")


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, be the table one file or a folder of files."""
    schema = table(spark, sf_dir, "documents").schema
    # A stream takes folders; a pattern may stand for a file as well, here for this one name.
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/documents.parque[t]")


def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "ingest")
    ingest(_arriving(spark, sf_dir), out, scratch_path(spark, "ingest-state")).awaitTermination()
    return longs(spark.read.parquet(out).select("doc_id", "pos", "text"), "pos")


def stream_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "ingest")
    state = scratch_path(spark, "ingest-state")
    ingest(
        _arriving(spark, sf_dir), out, state, "paragraph", hashed_words(DIM), DIM
    ).awaitTermination()
    flat = rows_of(spark.read.parquet(out), "doc_id", "pos").withColumn("value", rounded("value"))
    return longs(flat, "pos", "d")


QUERIES = {
    "src_jsonl": src_jsonl,
    "src_jsonl_strict": src_jsonl_strict,
    "src_jsonl_all": src_jsonl_all,
    "src_jsonl_first": src_jsonl_first,
    "embed_retried": embed_retried,
    "src_text_dir": src_text_dir,
    "src_messages": src_messages,
    "message_chunks": message_chunks,
    "corpus_jsonl": corpus_jsonl,
    "first_n_docs": first_n_docs,
    "chunk_sentences": chunk_sentences,
    "chunk_paragraphs": chunk_paragraphs,
    "chunk_paragraphs_delim": chunk_paragraphs_delim,
    "chunk_wrap": chunk_wrap,
    "corpus_profile": profile,
    "embed_chunks": embed_chunks,
    "doc_vectors": doc_vectors,
    "chunk_ids": chunk_ids,
    "query_set": query_vectors,
    "embedding_sets": embedding_sets,
    "knn_corpus": knn_corpus,
    "knn_with_text": knn_with_text,
    "stream_equals_batch": stream_equals_batch,
    "stream_embed": stream_embed,
}
