"""Packing of documents into token windows by multiway differencing.

A document becomes its token ids and an end id. Full windows are cut off long
documents; what is left is cut into pieces of at most ``MAX_PIECE`` tokens.
Pieces gather in blocks of about ``BLOCK`` windows; in a block the
Karmarkar-Karp method starts from partitions with one piece each and always
merges the two whose sums are most uneven, the largest sums of one with the
smallest of the other, until one partition into near-equal windows is left. If a
window holds more than the capacity, the block is dealt into one window more.

Each input partition is packed as it is read: nothing is shuffled, memory holds
one batch and one block, and a lost task is run again with the same result. At
most the last block of a partition is short.

Defined results: a null or empty text is the end id alone; repeated rows are
documents of their own; an empty table gives no pieces; a null doc_id is kept.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import whole

CAPACITY = 2048
END_ID = 1
MAX_PIECE = 512
BLOCK = 128
#: Tokens per window that a block leaves free, so that near-equal windows fit.
SLACK = 16
#: Sequence ids of one input partition.
PER_PARTITION = 1 << 40

PIECE = (
    "doc_id long, start long, length long, ids binary, "
    "doc_tokens long, sequence_id long, offset long"
)

#: White space of this length is left to the tokenizer file.
LONG_BLANK = 50_000
_BLANKS = re.compile(rf"\s{{{LONG_BLANK}}}")

_ENCODERS: dict[tuple[str, str], Callable[[str], list[int]]] = {}


def encoder(vocabulary: str, ranks: str):
    """Encodes one text as the tokenizer file ``vocabulary`` does.

    The rank file of the same vocabulary gives the same ids for a quarter of the
    time. Texts with the string of a special token, which is one id, and texts
    with a very long run of white space, on which its pattern matcher gives up,
    go to the tokenizer file itself.
    """
    if (vocabulary, ranks) not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        special = [token.content for token in exact.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(ranks), "rb") as lines:
            pairs = [line.split() for line in lines]
        merges = {base64.b64decode(token): int(rank) for token, rank in pairs}
        quick = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}
        )

        def encode(text: str) -> list[int]:
            if any(s in text for s in special) or (
                len(text) > LONG_BLANK and _BLANKS.search(text)
            ):
                return exact.encode(text, add_special_tokens=False).ids
            return quick.encode_ordinary(text)

        _ENCODERS[vocabulary, ranks] = encode
    return _ENCODERS[vocabulary, ranks]


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Places of ``sizes`` dealt into ``windows`` lists with near-equal sums.

    A partial partition is its sums in falling order with their members. Windows
    still empty are not stored, so an early merge only joins two short lists.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    if windows == 1:
        return [list(range(len(sizes)))]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        overlap = len(a) + len(b) - windows
        if overlap <= 0:
            merged = a + b
        else:
            # The smallest of a meet the smallest-last of b: largest with smallest.
            free_a, free_b = windows - len(a), windows - len(b)
            merged = b[:free_a] + a[:free_b]
            rest = zip(a[free_b:], reversed(b[free_a:]), strict=True)
            merged += [(x + y, p + q) for (x, p), (y, q) in rest]
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == windows else 0
        if least:
            merged = [(s - least, p) for s, p in merged]
        order += 1
        heapq.heappush(heap, (-merged[0][0], order, merged))
    dealt = [members for _, members in heap[0][2]] if heap else []
    return dealt


def pack_block(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Members of each window; one window more whenever one of them is over capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, windows)
        if all(sum(sizes[i] for i in members) <= capacity for members in dealt):
            return [m for m in dealt if m]
        windows += 1


class _Packer:
    """Gathers pieces ``(doc_id, start, ids, doc_tokens)`` and deals them block by block."""

    def __init__(self, first: int, capacity: int, max_piece: int, block: int) -> None:
        self.sequence, self.capacity, self.max_piece = first, capacity, max_piece
        self.target = block * (capacity - min(SLACK, capacity - 1))
        self.pieces: list[tuple] = []
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        while n - start >= self.capacity:
            self._window([(doc_id, start, ids[start : start + self.capacity], n)])
            start += self.capacity
        cuts = -(-(n - start) // self.max_piece)
        for k in range(cuts):
            end = start + -(-(n - start) // (cuts - k))
            while start < end:
                upto = min(end, start + self.target - self.held)
                self.pieces.append((doc_id, start, ids[start:upto], n))
                self.held += upto - start
                start = upto
                if self.held == self.target:
                    self.deal()

    def _window(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), ids.tobytes(), n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def deal(self) -> None:
        for members in pack_block([len(p[2]) for p in self.pieces], self.capacity):
            self._window([self.pieces[i] for i in sorted(members)])
        self.pieces, self.held = [], 0

    def taken(self) -> Iterator[pa.RecordBatch]:
        rows, self.rows = self.rows, []
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]
        names = [f.split()[0] for f in PIECE.split(", ")]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
        )


def pack(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
    capacity: int = CAPACITY,
    max_piece: int = MAX_PIECE,
    block: int = BLOCK,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece; ``ids`` are its ids as unsigned little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        first = TaskContext.get().partitionId() * PER_PARTITION
        packer = _Packer(first, capacity, max_piece, block)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py())
                ids.append(end_id)
                packer.add(doc_id.as_py(), np.array(ids, dtype="<u4"))
                if len(packer.rows) >= 4096:
                    yield from packer.taken()
        packer.deal()
        yield from packer.taken()

    return docs.select(F.col("doc_id").cast("long"), whole().alias("text")).mapInArrow(run, PIECE)
