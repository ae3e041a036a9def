"""Every stage on clashing column names, on nulls and on an empty table; shards against a plain order."""

from __future__ import annotations

import hashlib
import zlib

import pytest

import corpus_pipeline
from quillvec.llm import sharding

CLASHING = ("key", "row", "_key", "_row", "spans", "_spans", "_base", "_text", "mark", "text_sha256", "kept")
SCHEMA = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
TEXT = "the old mill by the river was built of stone and wood and it stands there to this day "


@pytest.fixture(scope="module")
def docs(spark):
    texts = [TEXT + "mail a.b@corp.org now", TEXT + "mail  a.b@corp.org now", TEXT * 3, None, "", "other words"]
    texts += [f"{TEXT} number {i} and some words of its own like w{i} v{i} u{i}" for i in range(6)]
    rows = [(i if i != 5 else None, t, len(t or ""), *(f"{c}{i}" for c in CLASHING)) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[2]], SCHEMA)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:4]])
def test_stages_keep_all_columns(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, docs, "")
    assert found.columns == docs.columns and dict(found.dtypes) == dict(docs.dtypes)
    given = {tuple(r[c] for c in CLASHING): r for r in docs.collect()}
    rows = found.collect()
    for row in rows:
        own = given[tuple(row[c] for c in CLASHING)]
        assert row.doc_id == own.doc_id
        if name == "private_spans":
            assert row.text == (own.text and own.text.replace("a.b@corp.org", "[EMAIL]"))
            assert row.n_chars == (None if own.text is None else len(row.text))
        else:
            assert row == own
    counts = {"private_spans": 13, "exact_dedup": 10}
    assert len(rows) == counts.get(name, len(rows)) and len(rows) > 0
    assert stage(spark, docs.limit(0), "").count() == 0


def test_shards_equal_a_plain_order(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = table.select("doc_id", "source", "text").collect()
    by_source = {}
    for r in rows:
        key = hashlib.md5(f"{sharding.SEED}:{r.doc_id}".encode()).hexdigest()
        by_source.setdefault(r.source, []).append((key, r.doc_id, r.text))
    order = []
    for source, own in by_source.items():
        for rank, (key, doc_id, text) in enumerate(sorted(own)):
            order.append(((2 * rank + 1) / (2 * len(own)), source, key, doc_id, text))
    order.sort(key=lambda o: o[:4])
    want, total = {}, len(order)
    for place, (*_, doc_id, text) in enumerate(order):
        shard = place * 8 // total
        raw = text.encode()
        want[doc_id] = (len(raw) + 1, zlib.crc32(raw), shard, place - -(-shard * total // 8))
    found = sharding.stratified_shards(table).collect()
    assert {r.doc_id: (r["size"], r.text_crc32, r.shard, r.slot) for r in found} == want
