"""The burst trie against a plain dictionary of prefixes, and against SQL."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import duckdb
import pytest

from quillvec.llm import conversation_trie, queries, sql

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n string"


def plain(rows, rebuilt=True):
    by_conv = {}
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            said = (role or "", text or "")
            key = (turn is not None, turn or 0, *(x.encode() for x in said))
            by_conv.setdefault(conv_id, []).append((key, said))
    turns = {c: [said for _, said in sorted(v)] for c, v in by_conv.items()}
    sequences = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6 if rebuilt else 0
        head = c - int(math.fmod(c, 100))
        sequences[c] = tuple(turns.get(head, [])[:h] + turns[c][h:])
    members = {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def subtree(node):
        leaves = 0 if children.get(node) else 1
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        for kid in children.get(node, []):
            below = subtree(kid)
            leaves, saved = leaves + below[0], saved + below[1]
        return leaves, saved

    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(node), parent, len(m), len(children.get(node, [])), *subtree(node), digest))
    return sorted(out, key=repr)


def made(spark, rows, rebuilt=True, **limits):
    turns = spark.createDataFrame(rows, SCHEMA)
    build = conversation_trie.rebuilt_conversations if rebuilt else conversation_trie.plain_conversations
    found = conversation_trie.trie(*build(turns), **limits)
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for c in [*range(40), 100, 105, 199, -3, -150, 250, 251]:
        for t in range(rng.randrange(1, 9)):
            out.append((c, t, rng.choice("ua"), rng.choice(["x", "yy"])))
    out += [(c, t, "u", "same") for c in range(300, 320) for t in range(12)]
    out += [(5, None, None, None)] * 2 + [(7, 3, "u", ""), (None, 1, "a", "b")]
    out += [(400, 1, "é", "😀" * 3), (500, 0, "u", "long " * 50_000)]
    return [(*r, 1, "n") for r in out]


@pytest.mark.parametrize("turns", [conversation_trie.CONTAINER_TURNS, 1, 20])
def test_equals_plain_trie(spark, rows, turns):
    assert made(spark, rows, container_turns=turns) == plain(rows)


def test_stretches_of_long_conversations(spark, rows, monkeypatch):
    monkeypatch.setattr(conversation_trie, "STRETCH", 3)
    monkeypatch.setattr(conversation_trie, "ENDS_BITS", 2)
    deep = rows[:200] + [(c, t, "u", str(t), 0, "") for c in (700, 701, 702) for t in range(40)]
    assert made(spark, deep, rebuilt=False, container_turns=30) == plain(deep, rebuilt=False)


def test_empty_table(spark):
    assert made(spark, []) == []


def test_sweep_of_one_container():
    members = [(4, ("a", "b"), [1, 2]), (2, ("a",), [1]), (9, ("a", "b", "c"), [1, 2, 3]), (3, ("a", "d"), [1, 5])]
    nodes = conversation_trie.sweep(members, 5)
    assert [n[:7] for n in nodes] == [
        [5, 2, None, 4, 2, 2, 5],
        [6, 4, 0, 2, 1, 1, 2],
        [7, 9, 1, 1, 0, 1, 0],
        [6, 3, 0, 1, 0, 1, 0],
    ]


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = queries.op12_conversation_trie(spark, sf_dir)
    wanted = con.execute(sql.OP12).fetchall()
    names = [d[0] for d in con.description]
    assert found.columns == names
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(wanted, key=repr)
