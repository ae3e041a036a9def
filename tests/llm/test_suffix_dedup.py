"""Repeated strings against a plain search, with hot lines, long texts, and ids that are null or stand twice."""

from __future__ import annotations

import hashlib
import random

import pytest

from quillvec.llm import suffix_dedup

SCHEMA = "doc_id long, text string, key string, first int"


def plain(rows):
    """Per row the bytes, removed bytes, spans and hash, by a dictionary of all strings."""
    texts = {}
    for doc_id, text in rows:
        place = (doc_id is None, doc_id or 0)
        texts[text or ""] = min(place, texts.get(text or "", place))
    first = {}
    width = suffix_dedup.WIDTH
    raw = {t: t.encode() for t in texts}
    for text, place in texts.items():
        data = raw[text]
        for i in range(len(data) - width + 1):
            string = data[i : i + width]
            here = (*place, suffix_dedup.text_key(data), i)
            if string not in first or here < first[string]:
                first[string] = here
    out = []
    for doc_id, text in rows:
        data, place = raw[text or ""], texts[text or ""]
        if (doc_id is None, doc_id or 0) != place and len(data) >= width:
            out.append((doc_id, len(data), len(data), 1, hashlib.sha256(b"").hexdigest()))
            continue
        goes = bytearray(len(data))
        key = suffix_dedup.text_key(data)
        for i in range(len(data) - width + 1):
            if first[data[i : i + width]] != (*place, key, i):
                goes[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(data, goes, strict=True) if not g)
        runs = sum(g and not (i and goes[i - 1]) for i, g in enumerate(goes))
        out.append((doc_id, len(data), sum(goes), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(spark, rows):
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    found = suffix_dedup.remove_repeats(docs).drop("removed").collect()
    return sorted((tuple(r) for r in found), key=repr)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    line = "this line stands in a third of all the texts, with other words round it"
    passage = words(rng, 60)
    out = []
    for i in range(240):
        text = words(rng, rng.randrange(5, 60))
        if i % 3 == 0:
            text = f"{words(rng, 20)}\n{line}\n{text}"
        if i % 7 == 0:
            text += passage + words(rng, 3)
        out.append((i, text))
    out += [(3, out[3][1]), (3, out[9][1] + " more"), (None, out[6][1]), (None, words(rng, 50) + passage)]
    out += [(500, None), (501, ""), (502, "é" * 300), (503, "ab" * 200)]
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_equals_plain_search(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HELD", 20_000)
    monkeypatch.setattr(suffix_dedup, "MARKS", 500)
    assert made(spark, rows) == plain(rows)


def test_a_text_of_a_megabyte(spark, rows):
    rng = random.Random(6)
    # No string of it comes twice but what it takes from another row.
    long = "".join(f"{i:07x}{rng.randrange(1 << 60):015x}" for i in range(1 << 16)) + rows[0][1]
    few = rows[:5] + [(900, long), (901, long)]
    found = {r[0]: r for r in made(spark, few)}
    assert found[900][1] == len(long) > 1 << 20
    assert found[901][2:4] == (len(long), 1)
    assert found[900][2] == len(rows[0][1].encode()) and found[900][3] == 1
    assert [r for r in made(spark, rows[:5])] == sorted((found[i] for i in range(5)), key=repr)


def test_only_thin_rows_are_written(spark, rows, monkeypatch):
    pinned = []

    def pin(df):
        pinned.append(df.columns)
        return df

    monkeypatch.setattr(suffix_dedup, "pin", pin)
    assert made(spark, rows) == plain(rows)
    assert pinned == [["doc_id", "key", "n_bytes", "sha"]]


def test_repeated_anchors_are_short(spark):
    rng = random.Random(7)
    text = words(rng, 30_000)
    docs = spark.createDataFrame([(1, text + " a"), (2, text + " b")], "doc_id long, text string").coalesce(1)
    data = [bytes(r.data) for r in suffix_dedup.repeated_anchors(docs).collect()]
    found = sum(len(h) for h, *_ in suffix_dedup.anchors([text.encode()]))
    # 13 bytes for each of the two texts; three longs were 24.
    assert 2 * found * 13 <= sum(map(len, data)) < 2 * found * 15


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_segments_do_not_follow_the_order_of_rows(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HELD", 20_000)
    docs = spark.createDataFrame({t: (i, t) for i, t in rows if t and i}.values(), "doc_id long, text string")
    buckets = suffix_dedup.FINE * suffix_dedup.partitions(docs)
    keys = [(suffix_dedup.text_key(r.text.encode()), r.doc_id) for r in docs.collect()]
    firsts = spark.createDataFrame(keys, "key long, first long")
    found = []
    for way in ("doc_id", "n"):
        dealt = docs.selectExpr("*", "-doc_id AS n").coalesce(1).sortWithinPartitions(way).select("doc_id", "text")
        texts, marks = suffix_dedup.packed_texts(dealt, buckets), suffix_dedup.repeated_anchors(dealt)
        cut = suffix_dedup.segments(texts, marks, firsts, buckets).collect()
        found.append(sorted((r.bucket, r.kind, bytes(r.data)) for r in cut))
    assert len(found[0]) > buckets and found[0] == found[1]
