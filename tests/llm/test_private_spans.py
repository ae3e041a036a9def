"""Spans added to the base ones against planted truth, and texts with very many matches."""

from __future__ import annotations

import random
import time

import pytest

from quillvec.llm import private_spans

NAMES = "anna.weber john.smith maria.lopez p.dubois karl.meier lucy.brown".split()
HOSTS = "example mail corp uni shop".split()
FILLER = "the report says that on and of all these things were found in time for it as before".split()
LEADS = {
    "email": ["please write my mail to", "contact me at", "kontakt", "e-mail of mr smith"],
    "ip": ["login from host", "the server address is", "user client ip", "ip"],
    "card": ["my card is", "credit card of the customer", "payment by visa", "karte"],
    "phone": ["call me at", "my phone is", "tel", "our fax and phone"],
}


def amex(rng):
    digits = [3, rng.choice((4, 7)), *(rng.randrange(10) for _ in range(12))]
    for last in range(10):
        full = [*digits, last]
        twice = [d * (1 + i % 2) for i, d in enumerate(reversed(full))]
        if sum(d - 9 if d > 9 else d for d in twice) % 10 == 0:
            text = "".join(map(str, full))
            return f"{text[:4]} {text[4:10]} {text[10:]}"
    raise AssertionError


def planted(rng, kind):
    if kind == "email":
        return f"{rng.choice(NAMES)} (at) {rng.choice(HOSTS)} (dot) {rng.choice(('com', 'org', 'de', 'fr'))}"
    if kind == "ip":
        return "[.]".join(str(rng.randrange(1, 224)) for _ in range(4))
    if kind == "card":
        return amex(rng)
    return f"({rng.randrange(201, 990)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"


def lookalike(rng):
    return rng.choice(
        [
            f"order {rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}",
            f"version {rng.randrange(300, 999)}[.]{rng.randrange(300, 999)}[.]{rng.randrange(9)}[.]{rng.randrange(9)}",
            f"serial 3782 {rng.randrange(100000, 999999)} {rng.randrange(10000, 99999)}",
            f"build 341{rng.randrange(10**11, 10**12)}",
            "look (at) that (dot) 7",
            f"price ${rng.randrange(200, 999)}.{rng.randrange(200, 999)}.{rng.randrange(1000, 9999)}",
            f"invoice total {rng.randrange(200, 999)}.{rng.randrange(200, 999)}.{rng.randrange(1000, 9999)}",
        ]
    )


def words(rng, n):
    return " ".join(rng.choice(FILLER) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng, rows, truth = random.Random(4), [], {}
    for i in range(900):
        text, kind = words(rng, rng.randrange(4, 20)), list(LEADS)[i % 4]
        if i % 3 == 0:
            text += f" {rng.choice(LEADS[kind])} "
            value = planted(rng, kind)
            truth[i] = (kind, len(text), len(text) + len(value))
            text += value
        elif i % 3 == 1:
            text += " " + lookalike(rng)
        else:
            base = {"email": "a.b@corp.org", "ip": "10.20.30.40", "card": "4111 1111 1111 1111", "phone": "+49 30 1234567"}
            text += f" {rng.choice(LEADS[kind])} {base[kind]}"
        rows.append((i, f"{text} {words(rng, 6)}"))
    return rows, truth


def test_added_spans_against_planted_truth(spark, corpus):
    rows, truth = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = private_spans.find(docs).collect()
    added = {(r.doc_id, s.kind, s.start, s.end) for r in found for s in r.spans if not s.base}
    wanted = {(i, *t) for i, t in truth.items()}
    right = added & wanted
    assert len(right) >= 0.9 * len(wanted), (len(right), len(wanted))
    assert len(right) >= 0.95 * len(added), sorted(added - wanted)[:9]
    assert sum(s.base for r in found for s in r.spans) == 300


def test_every_labeler_votes(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string")
    counts = private_spans.vote_counts(private_spans.candidates(docs))
    for place, name in enumerate(private_spans.LABELERS):
        votes = {v[place] for _, v, _ in counts}
        assert len(votes) >= 2, name
    model = private_spans.fit(counts)
    # Labelers that look at the match or round it tell more than chance.
    assert all(model.weights[v][1] > 0 for v in ("valid", "context"))
    assert all(model.weights[v][0] < 0 for v in ("valid", "context"))


def test_very_many_matches_in_one_text(spark):
    text = " and ".join(f"10.0.{i % 256}.{i % 200}" for i in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "x")], "doc_id long, text string")
    model = private_spans.fit([])
    private_spans.find(docs.where("doc_id > 1"), model=model).count()
    start = time.perf_counter()
    rows = {r.doc_id: r.spans for r in private_spans.find(docs, model=model).collect()}
    assert time.perf_counter() - start < 60
    assert len(rows[1]) == 100_000 and rows[2] == rows[3] == []
    last = rows[1][-1]
    assert text[last.start : last.end] == text.rpartition(" ")[2]
    assert all(a.end + 5 == b.start for a, b in zip(rows[1], rows[1][1:], strict=False))
