import json
import os

import pytest
from pyspark.sql import functions as F

from quillvec.plans import corpus_queries
from quillvec.sources import corpus
from quillvec.sources.corpus import read_corpus, read_jsonl, read_messages, write_jsonl, write_text_dir


def texts(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def test_jsonl_keeps_only_usable_lines(spark, tmp_path):
    lines = [
        '{"text": "one", "other": 1}', "", "not json", '{"text": ""}', '{"text": null}',
        '{"title": "no key"}', "12", '{"text": "cut off", "x":', '{"text": "  "}', "[1]", '"s"',
        '  {"text": "last"}  ',
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    assert texts(read_jsonl(spark, str(tmp_path))) == [(0, "one"), (1, "  "), (2, "last")]


def test_jsonl_other_key_and_limit(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"body": f"d{i}"}) for i in range(9)))
    docs = read_corpus(spark, "wikipedia", str(tmp_path), text_key="body", max_docs=3)
    assert texts(docs) == [(0, "d0"), (1, "d1"), (2, "d2")]
    assert texts(read_jsonl(spark, str(tmp_path), "body", max_docs=0)) == []


def test_ids_follow_path_then_position_over_many_splits(spark, tmp_path):
    for name in ("b", "a"):
        body = "\n".join(f"{name} message {i} {'.' * 80}" for i in range(400))
        (tmp_path / f"{name}.txt").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        found = texts(read_messages(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    wanted = [f"{n} message {i} {'.' * 80}" for n in ("a", "b") for i in range(400)]
    assert found == list(enumerate(wanted))


def test_text_dir_is_written_in_few_folders_and_read_in_name_order(spark, tmp_path):
    rows = [(i, f"text {i}\nö") for i in (1, 10, 100, 1000, 1001, 2, 10000, 99999)]
    docs = spark.createDataFrame(rows, "key long, text string")
    assert write_text_dir(docs, str(tmp_path), "key") == 8
    assert {p.name for p in tmp_path.iterdir()} == {"1", "10", "100", "2", "999"}
    found = read_corpus(spark, "text_dir", str(tmp_path)).orderBy("doc_id").collect()
    assert [r.doc_id for r in found] == list(range(8))
    assert [r.text for r in found] == [t + "\n" for _, t in sorted(rows, key=lambda r: str(r[0]))]


def test_text_dir_query_makes_no_folder_per_document(spark, tmp_path, monkeypatch):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x y").alias("text"))
    many.withColumns({"lang": F.lit("en"), "source": F.lit("s")}).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_queries, "scratch_path", lambda spark, label: str(tmp_path / label))
    assert corpus_queries.src_text_dir(spark, str(tmp_path)).count() == 3000
    folders = [p for p in (tmp_path / "texts").rglob("*") if p.is_dir()]
    assert len(folders) == 1000


def test_text_dir_skips_unusable_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.txt").write_text("second\nfile")
    (tmp_path / "sub" / "c.txt").write_text("third")
    (tmp_path / "a.txt").write_text("first")
    (tmp_path / "blank.txt").write_text(" \n ")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe broken")
    (tmp_path / "note.md").write_text("not text")
    docs = read_corpus(spark, "text_dir", str(tmp_path))
    assert texts(docs) == [(0, "first"), (1, "second\nfile"), (2, "third")]


def test_first_documents(spark, monkeypatch):
    docs = spark.range(0, 300, 3).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    for limit in (100, 5):  # sorted limit, then ranking of the keys
        monkeypatch.setattr(corpus, "SORTED_LIMIT", limit)
        found = corpus.first_docs(docs.repartition(5), 7)
        assert [i for i, _ in texts(found)] == [0, 3, 6, 9, 12, 15, 18]
    assert corpus.first_docs(docs, None) is docs


def test_other_encoding(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("na\u00efve\n\u00fcber".encode("latin-1"))
    path = str(tmp_path)
    assert texts(read_corpus(spark, "messages", path, encoding="ISO-8859-1")) == [
        (0, "na\u00efve"), (1, "\u00fcber"),
    ]
    assert texts(read_corpus(spark, "text_dir", path, encoding="ISO-8859-1")) == [
        (0, "na\u00efve\n\u00fcber"),
    ]
    assert texts(read_corpus(spark, "text_dir", path)) == []


def test_source_choice(spark):
    with pytest.raises(ValueError):
        read_corpus(spark, "other", "/x")
    with pytest.raises(ValueError):
        read_corpus(spark, "messages", "")


def test_jsonl_write_keeps_an_existing_corpus(spark, tmp_path):
    path = str(tmp_path / "out")
    make = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    write_jsonl(make("a", " ", None, "b\nc").coalesce(1), path)
    write_jsonl(make("ignored"), path)
    assert texts(read_jsonl(spark, path)) == [(0, "a"), (1, "b\nc")]
    write_jsonl(make("new"), path, force=True)
    assert texts(read_jsonl(spark, path)) == [(0, "new")]
    assert os.path.isdir(path)
