"""SentencePiece encoding with distinct sampled segmentations, and decoding.

The pieces of a text form a lattice; each segmentation has a probability given by
the pieces' weights. The Gumbel trick draws k segmentations without replacement:
every set of segmentations has a perturbed log-probability, the maximum over its members, so an
A-star search that always takes the set with the largest one apart meets complete
segmentations in the order of their perturbed values.

The lattice never crosses the start of a word, and a set is what is left open word
by word: the words before some place as in an earlier segmentation, at that place anything but
the ways of it already taken, after it anything. Taking a set apart draws one
segmentation, word by word and independent of its maximum, and leaves one smaller set
for every word from that place on, whose maxima are Gumbel values cut off at that of the set. So k + 1
draws give k segmentations and the threshold from which the inclusion scores follow:
the chance that a segmentation passes the threshold, by which a sum over the
sample is weighted to be unbiased. The draws of all texts of a batch are made together
in numpy; the random numbers are a hash of row key, text, seed and place.

The model file has merge ranks, no probabilities; a piece of rank r weighs
``-log(r + 2)``, less ``COST`` per piece. Bytes outside the vocabulary become byte
pieces, and so does a U+2581 of the text, which would else be read as a space. Words
are prepared once per task and kept.

Defined results: null and empty texts have one segmentation, the empty one, with
score 1; texts with fewer than k segmentations give them all, each with score 1;
the sample depends on the row key, the text and the seed only; repeated rows are
sampled alike; columns that are not keys are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.bytehash import mix

MODEL = "piece_bpe_32k.model"
SAMPLES = 3
SEED = 11
COST = 2.0
SPACE = "▁"
#: Places in words that a task keeps prepared.
KEPT_PLACES = 2_000_000
#: Texts, and characters of texts, drawn together.
TOGETHER, TOGETHER_CHARS = 512, 1 << 18
#: Stands for a U+2581 of the text; no text can hold it.
LITERAL = "\udc81"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

_LOADED: dict[str, Lattice] = {}


class Lattice:
    """The pieces of a model file and the prepared words."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.processor.get_piece_size()
        ids = range(n)
        self.bytes = [self.processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in ids if self.processor.is_control(i) or self.processor.is_unknown(i)}
        special |= set(self.bytes)
        pieces = [i for i in ids if i not in special]
        order = sorted(pieces, key=lambda i: -self.processor.get_score(i))
        total = math.log(sum(1 / (r + 2) for r in range(len(order))))
        self.weight = {
            self.processor.id_to_piece(i): (i, -math.log(r + 2) - total - COST)
            for r, i in enumerate(order)
        }
        self.byte_weight = -math.log(len(order) + 2) - total - COST
        self.longest = max(map(len, self.weight))
        self.clear()

    def clear(self) -> None:
        """Forget all prepared words.

        A place of a word is a state; its ways on are neighbours in flat arrays: next state
        (-1 at the end), piece (or the place of several in ``several``), log-probability, and
        the running probability plus the number of the state.
        """
        self.words: dict[str, int] = {}
        self.several: list[tuple[int, ...]] = []
        self.first: list[int] = [0]
        self.onward: list[int] = []
        self.piece: list[int] = []
        self.log: list[float] = []
        self.upto: list[float] = []
        self._arrays: tuple | None = None
        self._converted = 0

    def word(self, word: str) -> int:
        """The state at the start of ``word``."""
        state = self.words.get(word)
        if state is None:
            state = self.words[word] = len(self.first) - 1
            for ways in self._prepare(word):
                own, total = len(self.first) - 1, 0.0
                for end, ids, log in ways:
                    total += math.exp(log)
                    self.onward.append(state + end if end < len(word) else -1)
                    if len(ids) == 1:
                        self.piece.append(ids[0])
                    else:
                        self.several.append(ids)
                        self.piece.append(-len(self.several))
                    self.log.append(log)
                    self.upto.append(own + total)
                self.upto[-1] = own + 1.0
                self.first.append(len(self.onward))
        return state

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Next states, log-probabilities, running probabilities and pieces of all ways.

        Only what came since the last call is converted; room is made by doubling.
        """
        size = len(self.onward)
        if self._arrays is None:
            self._arrays, self._converted = tuple(np.zeros(1 << 16, t) for t in (int, float, float, int)), 0
        if size > len(self._arrays[0]):
            grown = 2 * size - len(self._arrays[0])
            self._arrays = tuple(np.concatenate([a, np.zeros(grown, a.dtype)]) for a in self._arrays)
        if size > self._converted:
            new = slice(self._converted, size)
            for array, values in zip(
                self._arrays, (self.onward, self.log, self.upto, self.piece), strict=True
            ):
                array[new] = values[new]
            self._converted = size
        return tuple(a[:size] for a in self._arrays)

    def draw(self, states: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ways from each state to the end, a row per state filled with -1, and their log-probability."""
        onward, log, upto, _ = self.arrays()
        total, steps = np.zeros(len(states)), []
        rows, at = np.arange(len(states)), states
        while len(rows):
            chance = _uniform(seeds[rows] + _number((len(steps) + 1) * _STEP))
            way = np.searchsorted(upto, at + chance * (1 - 1e-9), side="right")
            column = np.full(len(states), -1)
            column[rows] = way
            steps.append(column)
            total[rows] += log[way]
            open_ = onward[way] >= 0
            rows, at = rows[open_], onward[way][open_]
        ways = np.stack(steps, axis=1) if steps else np.zeros((len(states), 0), dtype=int)
        return ways, total

    def draw_other(self, state: int, taken: list[list[int]], rng: random.Random) -> list[int]:
        """Ways from ``state`` to the end that are none of ``taken``, by their probability."""
        out: list[int] = []
        while state >= 0:
            ways = range(self.first[state], self.first[state + 1])
            depth = len(out)
            weights = []
            for way in ways:
                through = sum(math.exp(sum(self.log[w] for w in t[depth:])) for t in taken if t[depth] == way)
                weights.append(max(0.0, math.exp(self.log[way]) - through))
            # Rounding may leave a way that is wholly taken a little above zero.
            for place, way in enumerate(ways):
                own = [t for t in taken if t[depth] == way]
                if own and self._all_taken(way, own, depth):
                    weights[place] = 0.0
            way = rng.choices(ways, weights)[0] if sum(weights) > 0 else next(
                w for w in ways if not self._all_taken(w, [t for t in taken if t[depth] == w], depth)
            )
            taken = [t for t in taken if t[depth] == way]
            out.append(way)
            state = self.onward[way]
        return out

    def _all_taken(self, way: int, taken: list[list[int]], depth: int) -> bool:
        """Whether every segmentation through ``way`` is among ``taken``, which go through it."""
        pending = [(way, taken, depth)]
        while pending:
            way, taken, depth = pending.pop()
            if not taken:
                return False
            state = self.onward[way]
            if state >= 0:
                pending += [
                    (w, [t for t in taken if t[depth + 1] == w], depth + 1)
                    for w in range(self.first[state], self.first[state + 1])
                ]
        return True

    def _all_taken_from(self, state: int, taken: list[list[int]]) -> bool:
        """Whether every segmentation from ``state`` on is among ``taken``."""
        ways = range(self.first[state], self.first[state + 1])
        return all(self._all_taken(w, [t for t in taken if t[0] == w], 0) for w in ways)

    def ids(self, ways: np.ndarray) -> list[int]:
        """Pieces of ways in order."""
        found = self.arrays()[3][ways].tolist()
        if not found or min(found) >= 0:
            return found
        return [i for p in found for i in ((p,) if p >= 0 else self.several[-p - 1])]

    def _prepare(self, word: str) -> list[list[tuple]]:
        n = len(word)
        after = [0.0] * (n + 1)
        ways: list[list[tuple]] = [[] for _ in range(n)]
        for at in range(n - 1, -1, -1):
            found = []
            for end in range(at + 1, min(n, at + self.longest) + 1):
                piece = self.weight.get(word[at:end])
                if piece is not None:
                    found.append((end, (piece[0],), piece[1] + after[end]))
            if not found or found[0][0] != at + 1:
                char = SPACE if word[at] == LITERAL else word[at].replace(SPACE, " ")
                raw = char.encode("utf-8", "surrogatepass")
                found.append(
                    (at + 1, tuple(self.bytes[b] for b in raw), len(raw) * self.byte_weight + after[at + 1])
                )
            most = max(f[2] for f in found)
            after[at] = most + math.log(sum(math.exp(f[2] - most) for f in found))
            ways[at] = [(end, ids, w - after[at]) for end, ids, w in found]
        return ways

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


def lattice(path: str) -> Lattice:
    if path not in _LOADED:
        _LOADED[path] = Lattice(path)
    return _LOADED[path]


_STEP = 0x9E3779B97F4A7C15


def _number(x: int) -> np.uint64:
    return np.uint64(x & (1 << 64) - 1)


def _uniform(seeds: np.ndarray) -> np.ndarray:
    """A number above 0 and below 1 for each seed."""
    return ((mix(seeds) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _cut_gumbel(location: np.ndarray, top: float, seeds: np.ndarray) -> np.ndarray:
    """Gumbel values of these locations below ``top``; minus infinity where there is nothing."""
    exponential = -np.log(_uniform(seeds))
    with np.errstate(over="ignore"):
        found = location - np.log(exponential + np.exp(location - top))
    return np.where(np.isneginf(location), -np.inf, np.minimum(found, top))


def _others(log: np.ndarray) -> np.ndarray:
    """Log-probability of anything else than something of this log-probability."""
    with np.errstate(divide="ignore"):
        rest = np.log(-np.expm1(np.minimum(log, 0.0)))
    return np.where(log > -1e-12, -np.inf, rest)


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of ways below each other, filled with -1 to the longest."""
    out = np.full((sum(map(len, parts)), max(p.shape[1] for p in parts)), -1)
    at = 0
    for part in parts:
        out[at : at + len(part), : part.shape[1]] = part
        at += len(part)
    return out


class _Text:
    """The search of one text: its words, the segmentations found, and the sets still open."""

    def __init__(self, seed: int, states: list[int]):
        self.seed, self.states = seed, np.array(states)
        #: Maximum, ways by word and log-probabilities by word of each segmentation found.
        self.found: list[tuple[float, np.ndarray, np.ndarray]] = []
        first = float(-np.log(-np.log(_uniform(np.array([seed], np.uint64))))[0])
        #: A set: -maximum, tie-break, segmentation it branches from, at which word, what is taken there.
        self.open: list[tuple] = [(-first, 0, None, -1, [])]
        self.made = 0

    def seeds(self, kind: int, words: np.ndarray) -> np.ndarray:
        base = _number(self.seed + (len(self.found) * 8 + kind + 1) * 0xD1B54A32D192ED03)
        return mix(base + words.astype(np.uint64) * _number(0x8CB92BA72F3D8DD7))


def _round(texts: list[_Text], k: int, pieces: Lattice) -> None:
    """Take the best open set of every text apart: one segmentation more, and the sets it leaves."""
    taken = [heapq.heappop(t.open) for t in texts]
    after = [np.arange(node[3] + 1, len(t.states)) for t, node in zip(texts, taken, strict=True)]
    ways, logs = pieces.draw(
        np.concatenate([t.states[a] for t, a in zip(texts, after, strict=True)]),
        np.concatenate([t.seeds(0, a) for t, a in zip(texts, after, strict=True)]),
    )
    at = 0
    for text, node, rest in zip(texts, taken, after, strict=True):
        worst, _, parent, place, gone = node
        own_ways, own_logs = ways[at : at + len(rest)], logs[at : at + len(rest)]
        at += len(rest)
        location, words = [], []
        if parent is not None:
            rng = random.Random(int(text.seeds(1, np.array([place]))[0]))
            other = pieces.draw_other(int(text.states[place]), gone, rng)
            log = sum(pieces.log[w] for w in other)
            own_ways = _stacked([text.found[parent][1][:place], np.array([other]), own_ways])
            own_logs = np.concatenate([text.found[parent][2][:place], [log], own_logs])
            gone = [*gone, other]
            mass = math.log(sum(math.exp(sum(pieces.log[w] for w in t)) for t in gone))
            location, words = [float(_others(np.array(mass)))], [place]
            if pieces._all_taken_from(int(text.states[place]), gone):
                location = [-np.inf]
        before = np.concatenate([[0.0], np.cumsum(own_logs)[:-1]])
        words = np.concatenate([words, rest]).astype(int)
        location = before[words] + np.concatenate([location, _others(own_logs[rest])])
        text.found.append((-worst, own_ways, own_logs))
        values = _cut_gumbel(location, -worst, text.seeds(2, words))
        # No more sets than segmentations still to come are ever taken.
        needed = k + 1 - len(text.found)
        for i in np.argsort(-values, kind="stable")[:needed].tolist():
            if values[i] > -np.inf:
                word = int(words[i])
                text.made += 1
                branch = gone if parent is not None and word == place else [own_ways[word][own_ways[word] >= 0].tolist()]
                heapq.heappush(text.open, (-values[i], text.made, len(text.found) - 1, word, branch))


def samples(texts: list[str], seeds: list[int], k: int, pieces: Lattice) -> list[list[tuple]]:
    """For each text ``(ids, log-probability, perturbed log-probability, inclusion score)`` of k segmentations."""
    out: list[list[tuple]] = [[((), 0.0, 0.0, 1.0)] for _ in texts]
    searches: dict[int, _Text] = {}
    for i, (text, seed) in enumerate(zip(texts, seeds, strict=True)):
        if text:
            spaced = SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)
            searches[i] = _Text(seed, [pieces.word(w) for w in _WORD.findall(spaced)])
    for _ in range(k + 1):
        open_ = [t for t in searches.values() if t.open]
        if open_:
            _round(open_, k, pieces)
    for i, text in searches.items():
        threshold = text.found[k][0] if len(text.found) > k else None
        out[i] = []
        for top, ways, logs in text.found[:k]:
            log = float(logs.sum())
            score = 1.0 if threshold is None else -math.expm1(-math.exp(min(50.0, log - threshold)))
            out[i].append((tuple(pieces.ids(ways[ways >= 0])), log, top, score))
    return out


def sample(text: str, k: int, rng: random.Random, pieces: Lattice) -> list[tuple]:
    """The samples of one text."""
    return samples([text], [rng.getrandbits(64)], k, pieces)[0]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``TOGETHER`` texts and about ``TOGETHER_CHARS`` characters."""
    for batch in batches:
        lengths = [len(t.as_py() or "") for t in batch.column("_text")]
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and (i - start == TOGETHER or held + n > TOGETHER_CHARS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start, len(lengths) - start)


ROW = "sample int, ids array<int>, log_prob double, perturbed double, inclusion double, decoded string"


def encode(
    rows: DataFrame,
    keys: list[str],
    text: str = "text",
    k: int = SAMPLES,
    seed: int = SEED,
    model: Callable[[], str] = model_path,
) -> DataFrame:
    """Per row and sample: the keys, ``sample`` from 0, ``ids``, scores, and the ids decoded again."""
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model())
        for batch in _pieced(batches):
            if len(pieces.first) > KEPT_PLACES:
                pieces.clear()
            at, out = [], []
            texts = [value or "" for value in batch.column("_text").to_pylist()]
            named = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            seeds = [
                xxhash.xxh3_64_intdigest(repr((seed, key, value)))
                for value, key in zip(texts, named, strict=True)
            ]
            for i, found in enumerate(samples(texts, seeds, k, pieces)):
                decoded = pieces.processor.decode([list(ids) for ids, *_ in found])
                for rank, ((ids, log, top, score), text) in enumerate(zip(found, decoded, strict=True)):
                    at.append(i)
                    out.append((rank, ids, log, top, score, text))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.list_(pa.int32()), *[pa.float64()] * 3, pa.string())
            yield pa.record_batch(
                [
                    *(batch.column(c).take(pa.array(at, pa.int64())) for c in keys),
                    *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)),
                ],
                names=[*keys, "sample", "ids", "log_prob", "perturbed", "inclusion", "decoded"],
            )

    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", " + ROW
    return rows.select(*keys, F.coalesce(text, F.lit("")).alias("_text")).mapInArrow(run, schema)
