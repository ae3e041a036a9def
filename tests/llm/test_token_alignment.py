"""Token alignment against a plain version that compares every token with every other."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillvec.llm import queries, token_alignment

NAMES = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
EDGE = [
    (1000, None),
    (1001, ""),
    (1002, "a▁b"),
    (1003, "日本 😀 ​ Ａ\n\n\t  x  <|endoftext|> <s> <0x41>"),
    (1004, " "),
    (1004, " "),
    (None, "no id"),
    (1005, "x" * 3000),
    (1006, " " * 60_000 + "end"),
]


def plain(rows):
    """Results by comparing the byte ranges of all pairs of tokens of a text."""
    tok = token_alignment.tokenizers(*NAMES)
    corpus, made = Counter(), []
    for doc_id, text in rows:
        (a_ids,), (b_ids,) = tok.both([text or ""])

        def ranges(ids, table):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i]), i))
                at += len(table[i])
            return out

        a, b = ranges(a_ids, tok.a_bytes), ranges(b_ids, tok.b_bytes)
        links = [(x[2], y[2]) for x in a for y in b if max(x[0], y[0]) < min(x[1], y[1])]
        corpus.update(links)
        groups, since = [], 0
        for cut in sorted({x[1] for x in a} & {y[1] for y in b}):
            sides = [[str(i) for _, end, i in s if since < end <= cut] for s in (a, b)]
            groups.append("|".join(",".join(s) for s in sides))
            since = cut
        made.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    best = {}
    for (_, y), n in corpus.items():
        best[y] = max(n, best.get(y, 0))
    return [
        (
            *m[:4],
            len(m[4]),
            sum(corpus[x] == best[x[1]] for x in m[4]),
            sum(corpus[x] for x in m[4]),
            m[5],
        )
        for m in made
    ]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80)
    cut = some.select("doc_id", F.substring("text", 1, 600).alias("text"), F.lit(1).alias("n_a"))
    edge = spark.createDataFrame([(*r, 2) for r in EDGE], "doc_id long, text string, n_a int")
    return cut.unionByName(edge)


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("limits", [{}, {"hot_pairs": 5, "pack_bytes": 5000}, {"hot_pairs": 1, "pack_bytes": 1}])
def test_equals_plain_version(docs, limits):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 50_000]
    few = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 50_000)
    found = token_alignment.align(few, **limits).collect()
    assert in_order(found) == in_order(plain(short))


def test_long_blanks_and_bytes(docs):
    rows = {r.doc_id: r for r in token_alignment.align(docs).collect()}
    tok = token_alignment.tokenizers(*NAMES)
    for doc_id in (1003, 1005, 1006):
        text = dict(EDGE)[doc_id]
        groups = [g.split("|") for g in rows[doc_id].groups.split(";")]
        for side, table in enumerate((tok.a_bytes, tok.b_bytes)):
            whole = b"".join(table[int(i)] for g in groups for i in g[side].split(","))
            assert whole == (" " + text).encode()
        for a, b in groups:
            assert sum(len(tok.a_bytes[int(i)]) for i in a.split(",")) == sum(
                len(tok.b_bytes[int(i)]) for i in b.split(",")
            )
    assert rows[1000].groups == rows[1001].groups == rows[1002].groups == ""
    assert sum(rows[1002][1:7]) == 0


def test_identity_map():
    tok = token_alignment.tokenizers(*NAMES)
    mapped = [(a, int(b)) for a, b in enumerate(tok.identity) if b >= 0]
    assert len(mapped) > 10_000
    assert all(tok.a_bytes[a] == tok.b_bytes[b] for a, b in mapped)


def test_empty_table_and_query(spark, docs, sf_dir):
    assert token_alignment.align(docs.limit(0)).count() == 0
    row = queries.op11_token_alignment(spark, sf_dir).orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").first().text
    groups = token_alignment.align(spark.createDataFrame([(0, text)], "doc_id long, text string"))
    assert row.groups_sha256 == hashlib.sha256(groups.first().groups.encode()).hexdigest()
