"""Alignment of the tokens of two tokenizers over the same bytes.

Tokenizer A reads ``space + text``, tokenizer B reads ``text`` and adds the space
itself, so both cover the same bytes. Byte offsets where tokens of both end cut
them into groups; the common refinement of all ends gives the links, one for each
A and B token that overlap. An id pair's count is how many links hold it in the
whole corpus.

Identity map: an array holds, for every A id, the B id of the same bytes. Links
of such a pair, nearly all of them one-to-one groups, are counted in a vector as
long as A's vocabulary, one per task. Only the other pairs are shuffled: each pack of
documents sends each of its distinct pairs once, the counts are added up, and the
counts of a pack's own pairs come back to it. The ``HOT_PAIRS`` most frequent
pairs take a second short way, as two sorted arrays sent to all tasks; so no pair
brings a large share of all packs to one task.

Tokenising is done once: a pack of about ``PACK_BYTES`` of text is stored in the
shared folder as one compressed code per link, from which the groups are written out
in the end. What reaches the driver or all tasks is bounded by the vocabularies
and ``HOT_PAIRS``.

Defined results: null and empty texts, and texts of which either tokenizer does
not give the bytes back (B reads U+2581 as a space), have no tokens: zeros and an
empty string. A null doc_id is kept, repeated rows are documents of their own and
count each time, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import whole
from quillvec.session import scratch_path

#: Bytes of text in a pack; a longer document is a pack of its own.
PACK_BYTES = 1 << 20
#: Pairs whose counts are sent to all tasks (16 bytes each).
HOT_PAIRS = 1 << 16
#: White space of this length is left to the tokenizer file.
LONG_BLANK = 50_000
#: Flags of a link: its A token, its B token begins here.
NEW_A, NEW_B = np.uint32(1 << 31), np.uint32(1 << 30)
CODE = np.uint32((1 << 30) - 1)

PACK = (
    "pack long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, codes binary, pairs array<long>, pair_counts array<long>, "
    "same_ids array<long>, same_counts array<long>"
)
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
    "count_sum long, groups string"
)


class Tokenizers:
    """The two tokenizers, the bytes of their ids and the identity map."""

    def __init__(self, vocabulary: str, ranks: str, pieces: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self._file = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self._file.encode_special_tokens = True
        with open(public_tokenizers.path(ranks), "rb") as lines:
            split = [line.split() for line in lines]
        merges = {base64.b64decode(token): int(rank) for token, rank in split}
        self._quick = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}
        )
        self._blanks = re.compile(rf"\s{{{LONG_BLANK}}}")
        self.a_bytes = [b""] * max(self._file.get_vocab_size(), max(merges.values()) + 1)
        for token, rank in merges.items():
            self.a_bytes[rank] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces))
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        self.a_len = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        # A piece is written after the byte of the same value, so it wins.
        order = sorted(range(self.n_b), key=lambda i: not self.b.is_byte(i))
        ordinary = (i for i in order if not (self.b.is_control(i) or self.b.is_unknown(i)))
        by_bytes = {self.b_bytes[i]: i for i in ordinary}
        self.identity = np.array(
            [by_bytes.get(x, -1) if x else -1 for x in self.a_bytes], dtype=np.int64
        )

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> list[int]:
        """Ids of the tokenizer file; the rank file gives the same ones faster."""
        if len(text) > LONG_BLANK and self._blanks.search(text):
            return self._file.encode(text, add_special_tokens=False).ids
        return self._quick.encode_ordinary(text)

    def both(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B for each text, both empty where one does not keep the bytes."""
        a_of, b_of = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        a_ids = [self.encode_a(" " + t) if t else [] for t in texts]
        b_ids = self.b.encode(texts, num_threads=1)
        for k, text in enumerate(texts):
            wanted = (" " + text).encode()
            if (
                not text
                or b"".join(map(b_of, b_ids[k])) != wanted
                or b"".join(map(a_of, a_ids[k])) != wanted
            ):
                a_ids[k], b_ids[k] = [], []
        return a_ids, b_ids


@cache
def tokenizers(vocabulary: str, ranks: str, pieces: str) -> Tokenizers:
    """Loaded once by each process."""
    return Tokenizers(vocabulary, ranks, pieces)


def _numbers(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, and how many each list has."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(sizes.sum())), sizes


def _pack(tok: Tokenizers, doc_ids: list, texts: list[str], same_total: np.ndarray) -> dict:
    """The row of a pack but its number; identical pairs are added to ``same_total``."""
    a_lists, b_lists = tok.both(texts)
    a, n_a = _numbers(a_lists)
    b, n_b = _numbers(b_lists)
    a_ends, b_ends = np.cumsum(tok.a_len[a]), np.cumsum(tok.b_len[b])
    n_bytes = int(a_ends[-1]) if len(a_ends) else 0
    marks = np.zeros(n_bytes + 1, dtype=np.uint8)
    marks[a_ends] = 1
    marks[b_ends] += 2
    ends = np.flatnonzero(marks)
    kind = marks[ends]
    a_end, b_end, shared = (kind & 1).astype(bool), kind >= 2, kind == 3
    # The token that a link lies in: as many have ended before.
    link_a = a[np.cumsum(a_end) - a_end]
    link_b = b[np.cumsum(b_end) - b_end]
    first = np.ones(min(1, len(ends)), dtype=bool)
    new_a, new_b = np.concatenate([first, a_end[:-1]]), np.concatenate([first, b_end[:-1]])

    same = tok.identity[link_a] == link_b
    same_total += np.bincount(link_a[same], minlength=tok.n_a)
    pairs, place, counts = np.unique(
        link_a[~same] * tok.n_b + link_b[~same], return_inverse=True, return_counts=True
    )
    codes = np.empty(len(ends), dtype=np.uint32)
    codes[same] = link_a[same]
    codes[~same] = tok.n_a + place
    codes |= new_a * NEW_A | new_b * NEW_B

    a_upto = np.concatenate([[0], np.cumsum(n_a)])
    doc_ends = np.concatenate([[0], a_ends])[a_upto]
    link_upto = np.searchsorted(ends, doc_ends, side="right")
    groups_upto = np.concatenate([[0], np.cumsum(shared)])[link_upto]
    return {
        "doc_ids": doc_ids,
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": np.diff(groups_upto),
        "n_links": np.diff(link_upto),
        "codes": zlib.compress(codes.tobytes(), 1),
        "pairs": pairs,
        "pair_counts": counts,
    }


def _packs(docs: DataFrame, names: tuple[str, str, str], pack_bytes: int) -> DataFrame:
    """Tokenised packs; the last one of a task carries its vector of identical pairs."""

    def row(pack: int, made: dict, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        made = {"pack": pack, **made, "same_ids": ids, "same_counts": counts}
        kinds = {"pack": pa.int64(), "codes": pa.binary()}
        return pa.record_batch(
            [pa.array([v], kinds.get(k, pa.list_(pa.int64()))) for k, v in made.items()],
            names=list(made),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(*names)
        pack = TaskContext.get().partitionId() << 33
        totals = np.zeros(tok.n_a, dtype=np.int64)
        none = np.zeros(0, dtype=np.int64)
        ids: list = []
        texts: list[str] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                held += len(texts[-1].encode())
                if held >= pack_bytes:
                    yield row(pack, _pack(tok, ids, texts, totals), none, none)
                    ids, texts, held, pack = [], [], 0, pack + 1
        made = _pack(tok, ids, texts, totals)
        used = np.flatnonzero(totals)
        yield row(pack, made, used, totals[used])

    return docs.select(F.col("doc_id").cast("long"), whole().alias("text")).mapInArrow(run, PACK)


def _array(numbers: pa.ListScalar) -> np.ndarray:
    """A list of whole numbers, null read as empty."""
    return np.array(numbers.values if numbers.is_valid else [], dtype=np.int64)


def _written(
    codes: np.ndarray, a: np.ndarray, b: np.ndarray, n_links: np.ndarray, words: dict
) -> list[str]:
    """The groups of each document: ``a1,a2|b1;a3|b2``."""
    new_a, new_b = (codes & NEW_A) != 0, (codes & NEW_B) != 0
    group = np.cumsum(new_a & new_b) - 1
    a_group, b_group = group[new_a], group[new_b]
    n = int(group[-1]) + 1 if len(group) else 0
    a_upto = np.concatenate([[0], np.cumsum(np.bincount(a_group, minlength=n))])
    b_upto = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=n))])
    parts = np.empty(len(a_group) + len(b_group), dtype=object)
    a_last = np.arange(1, len(a_group) + 1) == a_upto[a_group + 1]
    b_last = np.arange(1, len(b_group) + 1) == b_upto[b_group + 1]
    parts[np.arange(len(a_group)) + b_upto[a_group]] = words["a"][a_last.astype(int), a[new_a]]
    parts[np.arange(len(b_group)) + a_upto[b_group + 1]] = words["b"][b_last.astype(int), b[new_b]]
    upto = np.concatenate([[0], np.cumsum(n_links)])
    tokens = np.concatenate([[0], np.cumsum(new_a.astype(int) + new_b)])[upto]
    listed = parts.tolist()
    return ["".join(listed[s:e])[:-1] for s, e in zip(tokens[:-1], tokens[1:], strict=True)]


def align(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
    pieces: str = "piece_bpe_32k.model",
    pack_bytes: int = PACK_BYTES,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    ``n_best`` counts the links whose pair has the highest count of its B id,
    ``count_sum`` adds the counts of all links, ``groups`` lists the ids.
    """
    spark = docs.sparkSession
    names = (vocabulary, ranks, pieces)
    tok = tokenizers(*names)
    n_b = tok.n_b

    stored = scratch_path(spark, "token-packs")
    _packs(docs, names, pack_bytes).write.parquet(stored)
    packs = spark.read.schema(PACK).parquet(stored)

    # One row per A id at most.
    same = packs.select(F.explode(F.arrays_zip("same_ids", "same_counts")).alias("s"))
    counted = same.groupBy("s.same_ids").agg(F.sum("s.same_counts").alias("n")).toPandas()
    same_total = np.zeros(tok.n_a, dtype=np.int64)
    same_total[counted["same_ids"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)

    sums = scratch_path(spark, "pair-counts")
    (
        packs.select(F.explode(F.arrays_zip("pairs", "pair_counts")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair"))
        .agg(F.sum("p.pair_counts").alias("n"))
        .write.parquet(sums)
    )
    pairs = spark.read.schema("pair long, n long").parquet(sums)

    # One row per B id at most.
    tops = pairs.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("n")).toPandas()
    best = np.zeros(n_b, dtype=np.int64)
    best[tops["b"].to_numpy(dtype=np.int64)] = tops["n"].to_numpy(dtype=np.int64)
    known = tok.identity >= 0
    np.maximum.at(best, tok.identity[known], same_total[known])

    hot = pairs.orderBy(F.desc("n"), "pair").limit(hot_pairs).toPandas().sort_values("pair")
    sent = spark.sparkContext.broadcast(
        (same_total, best, hot["pair"].to_numpy(dtype=np.int64), hot["n"].to_numpy(dtype=np.int64))
    )
    hot_rows = spark.createDataFrame(pa.table({"pair": pa.array(hot["pair"], pa.int64())}))
    rest = (
        packs.select("pack", F.explode("pairs").alias("pair"))
        .join(F.broadcast(hot_rows), "pair", "left_anti")
        .join(pairs, "pair")
        .groupBy("pack")
        .agg(F.collect_list(F.struct("pair", "n")).alias("found"))
        .select("pack", F.col("found.pair").alias("found"), F.col("found.n").alias("found_n"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(*names)
        same_total, best, hot_pair, hot_n = sent.value
        words = {
            "a": np.array([[f"{i}{end}" for i in range(tok.n_a)] for end in ",|"], dtype=object),
            "b": np.array([[f"{i}{end}" for i in range(tok.n_b)] for end in ",;"], dtype=object),
        }
        for batch in batches:
            for k in range(batch.num_rows):
                one = {f: batch.column(f)[k] for f in batch.schema.names}
                pair = _array(one["pairs"])
                keys = np.concatenate([hot_pair, _array(one["found"])])
                values = np.concatenate([hot_n, _array(one["found_n"])])
                order = np.argsort(keys, kind="stable")
                pair_n = values[order][np.searchsorted(keys[order], pair)] if len(pair) else pair

                codes = np.frombuffer(zlib.decompress(one["codes"].as_py()), dtype=np.uint32)
                plain = (codes & CODE).astype(np.int64)
                a = np.concatenate([np.arange(tok.n_a), pair // tok.n_b])[plain]
                b = np.concatenate([tok.identity, pair % tok.n_b])[plain]
                n = np.concatenate([same_total, pair_n])[plain]
                n_links = _array(one["n_links"])
                upto = np.concatenate([[0], np.cumsum(n_links)])
                sums = np.concatenate([[0], np.cumsum(n)])[upto]
                hits = np.concatenate([[0], np.cumsum(n == best[b])])[upto]
                yield pa.record_batch(
                    [
                        one["doc_ids"].values,
                        *(one[f].values for f in ("n_a", "n_b", "n_groups", "n_links")),
                        pa.array(np.diff(hits), pa.int64()),
                        pa.array(np.diff(sums), pa.int64()),
                        pa.array(_written(codes, a, b, n_links, words), pa.string()),
                    ],
                    names=[f.split()[0] for f in ALIGNED.split(", ")],
                )

    needed = ("pack", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "codes", "pairs")
    return packs.select(*needed).join(rest, "pack", "left").mapInArrow(run, ALIGNED)
