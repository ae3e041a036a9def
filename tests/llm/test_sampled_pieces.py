"""Draws without replacement against the probabilities of all segmentations, and round trips."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from quillvec.llm import sampled_pieces


class Small(sampled_pieces.Lattice):
    """Five pieces; everything else is bytes."""

    def __init__(self):
        pieces = [("▁", -1.0), ("a", -1.0), ("b", -1.5), ("ab", -1.2), ("▁a", -0.7)]
        self.weight = {p: (i, w) for i, (p, w) in enumerate(pieces)}
        self.bytes, self.byte_weight, self.longest = list(range(100, 356)), -5.0, 2
        self.clear()


@pytest.mark.parametrize(("text", "k"), [("ab", 2), ("ab ab", 3), ("a b", 2), ("abab é", 4)])
def test_draws_without_replacement(text, k):
    small, runs = Small(), 3000
    every = sampled_pieces.samples([text], [1], 200, small)[0]
    chance = {ids: math.exp(log) for ids, log, *_ in every}
    assert len(chance) == len(every) and sum(chance.values()) == pytest.approx(1)
    assert all(score == 1.0 for *_, score in every)
    first, second, weighted = Counter(), Counter(), Counter()
    for rows in sampled_pieces.samples([text] * runs, list(range(7, 7 + runs)), k, small):
        assert len({ids for ids, *_ in rows}) == min(k, len(chance))
        assert all(a[2] >= b[2] for a, b in zip(rows, rows[1:], strict=False))
        assert all(math.exp(log) == pytest.approx(chance[ids]) for ids, log, *_ in rows)
        first[rows[0][0]] += 1
        second[rows[0][0], rows[1][0]] += 1
        for ids, log, _, score in rows:
            weighted[ids] += math.exp(log) / score
    for x, p in chance.items():
        assert abs(first[x] / runs - p) < 0.04
        # Weighting by inclusion scores makes sums over the sample unbiased.
        assert abs(weighted[x] / runs - p) < 0.05
        for y, q in chance.items():
            if x != y:
                assert abs(second[x, y] / runs - p * q / (1 - p)) < 0.04


def test_a_text_does_not_depend_on_its_neighbours():
    pieces = sampled_pieces.lattice(sampled_pieces.model_path())
    texts = ["one two three", "", "ünï 😀 code", "x" * 400]
    together = sampled_pieces.samples(texts, [1, 2, 3, 4], 3, pieces)
    pieces.clear()
    alone = [sampled_pieces.samples([t], [s], 3, pieces)[0] for t, s in zip(texts, [1, 2, 3, 4], strict=True)]
    assert together == alone and together[1] == [((), 0.0, 0.0, 1.0)]


@pytest.mark.parametrize("text", ["a▁b", "▁", "  x ▁▁ y ", "Ünï 😀 ​", "q" * 2000, "日本語 x\n\ty", " ", "\x00<s></s>"])
def test_round_trip(text):
    pieces = sampled_pieces.lattice(sampled_pieces.model_path())
    rows = sampled_pieces.sample(text, 3, random.Random(1), pieces)
    assert all(pieces.decode(list(ids)) == text for ids, *_ in rows)
    assert len({ids for ids, *_ in rows}) == len(rows)


def test_other_ways_than_those_taken():
    small = Small()
    state = small.word("▁ab")
    taken, seen = [], Counter()
    ways = {tuple(small.draw_other(state, [], random.Random(i))) for i in range(300)}
    assert len(ways) == 3
    for way in sorted(ways)[:2]:
        taken.append(list(way))
        found = {tuple(small.draw_other(state, taken, random.Random(i))) for i in range(100)}
        assert found == ways - {tuple(t) for t in taken}
        seen.update(found)
    assert not small._all_taken_from(state, taken)
    assert small._all_taken_from(state, [list(w) for w in ways])
