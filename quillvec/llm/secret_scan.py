"""Secrets in texts: fixed patterns, and strings that pass for random.

Three patterns give the base spans. Beyond them every run of 16 or more key
characters is a candidate: its encoding is inferred (hex, base 32, base 36, base 64)
and a battery asks whether it could be uniformly random in that alphabet:

* chi-squared over the symbols, standardised with its exact moments;
* runs of character classes (letters, capitals, digits, signs) against their
  exact expectation and variance;
* correlation of neighbouring symbols.

The squares of the three add up to one statistic, small for random strings and
larger the longer an ordinary string is. False discoveries are strings of
ordinary writing that look random by chance, so that is the null: each candidate
brings a decoy of its own length and encoding, written with the letters around it
(for hex, their character codes). Over all decoys of the corpus the logarithm of
the statistic is fitted as a line in the logarithm of the length, per encoding;
that turns each candidate into a p-value. The p-values are weighted by length and
the Benjamini-Hochberg step at ``FALSE_DISCOVERIES`` takes those that the null
does not explain, if they also pass the battery. The step works on a
histogram of all candidates by encoding, length class and score, whose size does
not depend on the corpus, so nothing else reaches the driver.

Spans are ``kind:start:end`` in code points, end exclusive; an added span has the
kind ``random`` and touches no base span. Digits alone are no candidates.

Defined results: null and empty texts have no spans; a null doc_id is kept;
repeated rows are scanned, and counted in the fit, each on its own; other columns are
ignored; an empty table gives no rows. With fewer than ``LEAST_DECOYS`` decoys an
encoding takes the line of all encodings, and without those nothing is added.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import whole
from quillvec.session import scratch_path

# The base patterns, in the order that spans are listed in.
PATTERNS = {
    "assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
KINDS = (*PATTERNS, "random")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Candidates: this many key characters or more, then padding.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
FALSE_DISCOVERIES = 0.01
LEAST_DECOYS = 8
#: The battery's sum of three squares for a random string is beyond this once in a thousand times.
RANDOM_MOST = 16.27
#: Candidates in one score step of the histogram share a p-value, that of its upper end.
STEPS_PER_SIGMA = 20
LOWEST_SCORE, HIGHEST_SCORE = -30.0, 0.0
CLASSES_PER_DOUBLING = 4

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = re.compile(r"[A-Za-z]")


@dataclass(frozen=True)
class Encoding:
    """An alphabet in order, and the class of each of its characters."""

    symbols: str
    classes: tuple[int, ...]
    #: Alternatives that stand for the same symbol.
    also: tuple[tuple[str, str], ...] = ()

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        index, kind = np.full(128, -1), np.full(128, -1)
        for i, c in enumerate(self.symbols):
            index[ord(c)], kind[ord(c)] = i, self.classes[i]
        for c, same in self.also:
            index[ord(c)], kind[ord(c)] = index[ord(same)], kind[ord(same)]
        return index, kind


def _alphabet(*parts: str, also: tuple[tuple[str, str], ...] = ()) -> Encoding:
    classes = tuple(k for k, part in enumerate(parts) for _ in part)
    return Encoding("".join(parts), classes, also)


HEX, BASE32, BASE36, BASE64 = range(4)
ENCODINGS = (
    _alphabet(_DIGITS, "abcdef", also=tuple(zip("ABCDEF", "abcdef", strict=True))),
    _alphabet(_UPPER, "234567"),
    _alphabet(_DIGITS, _LOWER),
    _alphabet(_UPPER, _LOWER, _DIGITS, "+/", also=(("-", "+"), ("_", "/"))),
)
_TABLES = [e.table() for e in ENCODINGS]
_SHAPES = (
    (HEX, re.compile(r"(?=.*[a-f])(?=.*[0-9])[0-9a-f]+|(?=.*[A-F])(?=.*[0-9])[0-9A-F]+")),
    (BASE32, re.compile(r"[A-Z2-7]+")),
    (BASE36, re.compile(r"[0-9a-z]+")),
)


def infer(key: str) -> int | None:
    """The narrowest encoding that ``key`` fits; none for digits alone."""
    if key.isdigit():
        return None
    return next((e for e, shape in _SHAPES if shape.fullmatch(key)), BASE64)


def battery(key: str, encoding: int) -> float:
    """Sum of the squared standard scores of the three tests; padding must be off."""
    n, k = len(key), len(ENCODINGS[encoding].symbols)
    codes = np.frombuffer(key.encode("ascii"), dtype=np.uint8)
    index, kind = _TABLES[encoding][0][codes], _TABLES[encoding][1][codes]
    counts = np.bincount(index, minlength=k).astype(float)
    uneven = k * (counts**2).sum() / n - n
    chi = max(0.0, (uneven - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))

    share = np.bincount(ENCODINGS[encoding].classes) / k
    change = 1 - (share**2).sum()
    together = (share * (1 - share) ** 2).sum() - change**2
    expected = (n - 1) * change
    spread = (n - 1) * change * (1 - change) + 2 * (n - 2) * together
    runs = (np.count_nonzero(kind[1:] != kind[:-1]) - expected) / math.sqrt(spread)

    x = index - index.mean()
    size = (x**2).sum()
    serial = 1.0 if size == 0 else (x[1:] * x[:-1]).sum() / size
    return chi**2 + runs**2 + (serial + 1 / n) ** 2 * n


def decoy(text: str, start: int, end: int, n: int, encoding: int) -> str | None:
    """``n`` symbols of ordinary writing: the letters before a candidate, else those after it."""
    need = -(-n // 2) if encoding == HEX else n
    letters = ""
    upto = start
    while len(letters) < need and upto > 0:
        since = max(0, upto - 2 * need)
        letters = "".join(_LETTERS.findall(text, since, upto)) + letters
        upto = since
    letters = letters[-need:]
    since = end
    while len(letters) < need and since < len(text):
        letters += "".join(_LETTERS.findall(text, since, since + 2 * need))
        since += 2 * need
    letters = letters[:need]
    if len(letters) < need:
        return None
    if encoding == HEX:
        return letters.encode("ascii").hex()[:n]
    return letters.upper() if encoding == BASE32 else letters.lower() if encoding == BASE36 else letters


class Scanner:
    """Base spans, candidates and decoys of one text."""

    def __init__(self) -> None:
        flags = {"assign": re.IGNORECASE | re.ASCII}
        self.patterns = [(re.compile(p, flags.get(k, 0)), k) for k, p in PATTERNS.items()]

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """``(start, kind, end)`` in order."""
        found = []
        for number, (pattern, kind) in enumerate(self.patterns):
            counted = 2 if kind == "assign" else 0
            for m in pattern.finditer(text):
                if m.end(counted) - m.start(counted) >= LEAST[kind]:
                    found.append((m.start(), number, m.end()))
        return sorted(found)

    def scan(self, text: str) -> tuple[list, list, list]:
        base = self.base(text)
        # Base spans may overlap each other; the furthest end so far decides.
        reach, open_ = [], 0
        for _, _, end in base:
            open_ = max(open_, end)
            reach.append(open_)
        found, decoys, at = [], [], 0
        for m in CANDIDATE.finditer(text):
            key = m.group().rstrip("=")
            encoding = infer(key)
            if encoding is None:
                continue
            other = decoy(text, m.start(), m.end(), len(key), encoding)
            if other is not None:
                decoys.append((encoding, len(key), battery(other, encoding)))
            while at < len(base) and base[at][0] < m.end():
                at += 1
            if at == 0 or reach[at - 1] <= m.start():
                found.append((m.start(), m.end(), encoding, len(key), battery(key, encoding)))
        return base, found, decoys


_BASE = "array<struct<start:long,kind:int,end:long>>"
_FOUND = "array<struct<start:long,end:long,encoding:int,length:long,statistic:double>>"
_DECOYS = "array<struct<encoding:int,length:long,statistic:double>>"
SCANNED = f"doc_id long, base {_BASE}, found {_FOUND}, decoys {_DECOYS}"


def _scanned(docs: DataFrame) -> DataFrame:
    def struct(**fields: pa.DataType) -> pa.DataType:
        return pa.list_(pa.struct(list(fields.items())))

    whole_, small, real = pa.int64(), pa.int32(), pa.float64()
    kinds = [
        struct(start=whole_, kind=small, end=whole_),
        struct(start=whole_, end=whole_, encoding=small, length=whole_, statistic=real),
        struct(encoding=small, length=whole_, statistic=real),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [scanner.scan(text.as_py()) for text in part.column(1)]
                lists = [
                    pa.array(
                        [[dict(zip(f, x, strict=True)) for x in row[k]] for row in rows], kind
                    )
                    for k, kind in enumerate(kinds)
                    for f in [[field.name for field in kind.value_type]]
                ]
                yield pa.record_batch(
                    [part.column(0), *lists], names=["doc_id", "base", "found", "decoys"]
                )

    return docs.select(F.col("doc_id").cast("long"), whole().alias("text")).mapInArrow(run, SCANNED)


def _log(x: Column | str) -> Column:
    return F.log(F.greatest(F.col(x) if isinstance(x, str) else x, F.lit(0.01)))


@dataclass(frozen=True)
class Line:
    """How the logarithm of the statistic of ordinary writing depends on that of the length."""

    constant: float
    slope: float
    sigma: float


def fit_null(scanned: DataFrame) -> dict[int, Line]:
    """A line for each encoding, from sums over all decoys."""
    x, y = F.log("length"), _log("statistic")
    sums = (
        scanned.select(F.explode("decoys").alias("d"))
        .select("d.*")
        .groupBy("encoding")
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            *(F.sum(v).alias(a) for v, a in ((x, "x"), (y, "y"), (x * x, "xx"), (x * y, "xy"), (y * y, "yy"))),
        )
        .collect()
    )
    rows = {r["encoding"]: np.array(r[1:], dtype=float) for r in sums}
    pool = sum(rows.values(), np.zeros(6))
    lines = {}
    for encoding in range(len(ENCODINGS)):
        own = rows.get(encoding, np.zeros(6))
        n, sx, sy, sxx, sxy, syy = own if own[0] >= LEAST_DECOYS else pool
        if n < LEAST_DECOYS:
            continue
        var = sxx / n - (sx / n) ** 2
        slope = (sxy / n - sx * sy / n**2) / var if var > 1e-9 else 0.0
        left = syy / n - (sy / n) ** 2 - slope**2 * max(var, 0.0)
        lines[encoding] = Line((sy - slope * sx) / n, slope, max(0.2, math.sqrt(max(0.0, left))))
    return lines


def _below(score: float) -> float:
    """The normal distribution function."""
    return 0.5 * math.erfc(-score / math.sqrt(2))


def discoveries(
    cells: list[tuple[int, int, int, int]], rate: float = FALSE_DISCOVERIES
) -> dict[tuple[int, int], int]:
    """Last score step that counts as a discovery, by encoding and length class.

    ``cells`` are ``(encoding, length class, step, candidates)``. The p-value of a
    cell is divided by its weight, its length over the mean length.
    """
    total = sum(n for *_, n in cells)
    lengths = {c: 2 ** ((c + 0.5) / CLASSES_PER_DOUBLING) for _, c, _, _ in cells}
    if not total:
        return {}
    mean = sum(lengths[c] * n for _, c, _, n in cells) / total
    ranked = sorted(
        (_below((step + 1) / STEPS_PER_SIGMA) * mean / lengths[c], n, (e, c), step)
        for e, c, step, n in cells
    )
    seen, most = 0, -1.0
    for p, n, _, _ in ranked:
        seen += n
        if p * total <= rate * seen:
            most = p
    last: dict[tuple[int, int], int] = {}
    for p, _, cell, step in ranked:
        if p <= most:
            last[cell] = max(step, last.get(cell, step))
    return last


def scan(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """``doc_id, base, spans`` for each row: arrays of ``(start, kind, end)``, kinds by their place in ``KINDS``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "secret-scan")
    _scanned(docs).write.parquet(path)
    scanned = spark.read.schema(SCANNED).parquet(path)
    lines = fit_null(scanned)
    none = F.array().cast(_BASE)
    if not lines:
        return scanned.select("doc_id", "base", F.col("base").alias("spans"))

    def of(values: dict, key: Column) -> Column:
        pairs = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items())
        return F.element_at(F.create_map(*pairs), key)

    def step(c: Column) -> Column:
        e = c["encoding"]
        expected = of({k: x.constant for k, x in lines.items()}, e) + of(
            {k: x.slope for k, x in lines.items()}, e
        ) * F.log(c["length"])
        score = (_log(c["statistic"]) - expected) / of({k: x.sigma for k, x in lines.items()}, e)
        held = F.least(F.greatest(score, F.lit(LOWEST_SCORE)), F.lit(HIGHEST_SCORE))
        return F.floor(held * STEPS_PER_SIGMA).cast("int")

    def length_class(c: Column) -> Column:
        return F.floor(F.log2(c["length"]) * CLASSES_PER_DOUBLING).cast("int")

    tested = scanned.select(F.explode("found").alias("c"))
    cells = (
        tested.groupBy(F.col("c.encoding"), length_class(F.col("c")), step(F.col("c"))).count().collect()
    )
    last = discoveries([tuple(r) for r in cells], rate)
    if not last:
        return scanned.select("doc_id", "base", F.col("base").alias("spans"))
    limits = {f"{e}:{c}": s for (e, c), s in last.items()}

    def taken(c: Column) -> Column:
        cell = F.concat_ws(":", c["encoding"], length_class(c))
        limit = F.coalesce(F.try_element_at(_literal_map(limits), cell), F.lit(-(1 << 30)))
        return (step(c) <= limit) & (c["statistic"] <= RANDOM_MOST)

    def added(c: Column) -> Column:
        return F.struct(
            c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")
        )

    more = F.transform(F.filter("found", taken), added)
    spans = F.array_sort(F.concat("base", F.coalesce(more, none)))
    return scanned.select("doc_id", "base", spans.alias("spans"))


def _literal_map(values: dict[str, int]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))


def listed(spans: str) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def digest(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """Counts of base spans, their hash, and all spans as text."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return scan(docs, rate).select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(PATTERNS)),
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
