"""Removal of repeated byte strings by longest previous factors, keeping the first copy.

A byte goes if a string of ``WIDTH`` bytes over it also starts earlier, in a text
of a smaller doc_id or before it in the same text.

1. Equal texts: the first stands for all; of the others every byte goes.
2. Each string of ``WIDTH`` bytes has an anchor, the stretch of ``GRAM`` bytes in
   it with the least hash (the leftmost of equals). Equal strings have equal
   anchors, so strings are dealt to owners by anchor; about one stretch in thirty
   is one. Owners of anchor ranges first find which anchors stand in two places.
3. Around those anchors only, the segments holding their strings are cut out.
   Equal segments are settled by place: the first stays. Segments at an anchor
   that more than ``HOT`` texts share are first cut into their strings, which are
   dealt by their own hash. Of the different segments at one anchor the owner builds the suffix order of the strings, the
   common prefix lengths of neighbours in it, and from previous and next smaller
   places the longest previous factor of each; ``WIDTH`` or more means it goes.
4. The bytes to go are joined with the texts once more and cut out.

Texts travel packed and compressed, each text once per task however often it
stands there; positions travel as arrays. Texts are named by 64-bit hashes. To find
repeated anchors, anchors and texts are named by 32 bits and their bucket: two of one
name bring segments that match nothing, and lose none. Strings are compared as bytes.

Defined results: null and empty texts have no bytes and no removals; texts
shorter than ``WIDTH`` lose nothing; repeated rows (same doc_id and text) count
as one text and get one result each; a null doc_id comes last; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.bytehash import chunks, mix, prefix_sums, windows
from quillvec.llm.common import partitions, whole
from quillvec.session import pin

WIDTH = 100
GRAM = 40
SPREAD = WIDTH - GRAM + 1
#: Bytes of text, and entries, that a task packs together before it sends them.
PACK = 16 << 20
#: Buckets per task; a task holds the data of one bucket at a time.
FINE = 2
#: Strings of different segments that are sorted at a time.
SORTED = 1 << 16
#: Repeated anchors that a task gathers before it sends them on.
MARKS = 1 << 18
#: Texts with one anchor beyond which its strings are dealt one by one.
HOT = 1 << 11
#: Bytes of segments, each with ``CELL`` bytes for its entry, that a task gathers.
HELD = 32 << 20
CELL = 256
LAST = (1 << 63) - 1
LOW = (1 << 32) - 1
PACKED = "bucket int, kind int, data binary"
#: Short name of the text, bucket and short name of the anchor, hot.
MARK = ("<u4", "<u4", "<u4", "u1")
#: Key of the text, first string, how many go.
LOSS = ("<i8", "<u4", "<u4")
#: Key of the text, its first doc_id.
FIRST = ("<i8", "<i8")
#: Short name of the anchor, doc_id, key, first string, strings, the anchor's place.
HEAD = ("<u4", "<i8", "<i8", "<u4", "u1", "u1")


def text_key(text: bytes) -> int:
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh3_64_intdigest(text)))[0]


def _bucket(key, buckets: int):
    """The bucket of a text, from the part of its key that is its short name."""
    return (key & LOW) % buckets


def _anchor(hashes, buckets: int):
    """Bucket of an anchor, in the high half, and its short name, from unsigned hashes."""
    return (((hashes >> 32) % buckets) << 32) | (hashes & LOW)


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Per text: anchor hashes, the first string start of each, how many strings, the anchor's place.

    The place counts from the first string start.
    """
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    for start, end in chunks(texts, 1 << 19):
        part = texts[start:end]
        data = np.frombuffer(b"".join(part), dtype=np.uint8)
        if len(data) < WIDTH:
            yield from (none for _ in part)
            continue
        hashes = mix(windows(prefix_sums(data), GRAM))
        places = np.arange(len(hashes), dtype=np.uint64)
        low = np.uint64((1 << 32) - 1)
        least = (hashes & ~low) | places  # by hash, the leftmost of equals
        step, span = 1, 1
        while span < SPREAD:  # minima of runs of doubling length, then of SPREAD
            step = min(span, SPREAD - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        at = (least & low).astype(np.int64)
        begin = 0
        for text in part:
            count = len(text) - WIDTH + 1
            if count <= 0:
                yield none
            else:
                mine = at[begin : begin + count]
                first = np.flatnonzero(np.diff(mine, prepend=-1))
                lead = mine[first] - begin - first
                yield hashes[mine[first]], first, np.diff(first, append=count), lead
            begin += len(text)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    """Packs of ``(key, text)``, each text once per pack; texts too short to match are left out."""
    pack: dict[int, bytes] = {}
    held = 0
    for batch in batches:
        for value in batch.column("text"):
            text = value.as_py().encode("utf-8", "surrogatepass")
            if len(text) < WIDTH:
                continue
            key = text_key(text)
            if key not in pack:
                pack[key] = text
                held += len(text)
            if held >= PACK:
                yield list(pack.items())
                pack, held = {}, 0
    if pack:
        yield list(pack.items())


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    types = (pa.int32(), pa.int32(), pa.binary())
    return pa.record_batch(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
        names=["bucket", "kind", "data"],
    )


def _split(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    parts = [np.split(c[order], cuts) for c in (bucket, *columns)]
    for own, *rest in zip(*parts, strict=True):
        if len(own):
            yield int(own[0]), rest


def _joined(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts)


def _parted(data: bytes, n: int) -> list[bytes]:
    sizes, at, out = struct.unpack_from(f"<{n}q", data), 8 * n, []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """The anchors of each text that stand in two places, packed by bucket of the text.

    Rows of kind 1 hold columns as in ``MARK``; an anchor is hot if more than
    ``HOT`` texts have it.
    """
    buckets = FINE * partitions(docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _texts(batches):
            names = np.array([k & LOW for k, _ in pack], dtype="<u4")
            found = [h for h, *_ in anchors([t for _, t in pack])]
            owner = np.repeat(np.arange(len(pack), dtype=np.uint32), [len(h) for h in found])
            named = _anchor(np.concatenate(found), buckets)
            bucket = (named >> 32).astype(np.int32)
            rows = [
                (b, 0, _joined(h.tobytes(), n.tobytes()))
                for b, (h, n) in _split(bucket, named.astype("<u4"), names[owner])
            ]
            yield _rows(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            marks = [np.concatenate([f[c] for f in found]) for c in range(len(MARK))]
            found.clear()
            return _rows(_by_text(marks, MARK, buckets, 1))

        for bucket, rows in _by_bucket(batches):
            parts = [[np.frombuffer(p, "<u4") for p in _parted(data, 2)] for _, data in rows]
            anchor, name = (np.concatenate([p[c] for p in parts]) for c in range(2))
            del parts
            order = np.argsort(anchor, kind="stable")
            anchor, name = anchor[order], name[order]
            first = np.flatnonzero(np.diff(anchor, prepend=~anchor[:1]))
            times = np.diff(first, append=len(anchor))
            times = np.repeat(times, times)
            often = times > 1
            place = np.full(int(often.sum()), bucket, dtype="<u4")
            found.append((name[often], place, anchor[often], times[often] > HOT))
            held += len(place)
            if held >= MARKS:
                yield flush()
                held = 0
        if found:
            yield flush()

    sent = docs.mapInArrow(send, PACKED)
    return _dealt(sent, buckets).mapInArrow(meet, PACKED)


def _by_text(
    columns: list[np.ndarray], types: tuple[str, ...], buckets: int, kind: int
) -> list[tuple[int, int, bytes]]:
    """Rows of ``kind`` for arrays of which the first holds keys or short names of texts."""
    bucket = _bucket(columns[0], buckets).astype(np.int32)
    columns = [c.astype(t) for c, t in zip(columns, types, strict=True)]
    return [
        (b, kind, _joined(*(p.tobytes() for p in parts))) for b, parts in _split(bucket, *columns)
    ]


def packed_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """Texts compressed together by the bucket of their key, as rows of kind 0."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for pack in _texts(batches):
            by: dict[int, list[tuple[int, bytes]]] = {}
            for key, text in pack:
                by.setdefault(_bucket(key, buckets), []).append((key, text))
            yield _rows([(b, 0, squeeze.compress(_pack_texts(own))) for b, own in by.items()])

    return docs.mapInArrow(send, PACKED)


def _pack_texts(own: list[tuple[int, bytes]]) -> bytes:
    keys = np.array([k for k, _ in own], dtype=np.int64)
    sizes = np.array([len(t) for _, t in own], dtype=np.int64)
    return _joined(keys.tobytes(), sizes.tobytes(), b"".join(t for _, t in own))


def _unpack_texts(data: bytes) -> Iterator[tuple[int, bytes]]:
    keys, sizes, texts = _parted(zstandard.ZstdDecompressor().decompress(data), 3)
    at = 0
    for key, size in zip(
        np.frombuffer(keys, np.int64).tolist(), np.frombuffer(sizes, np.int64).tolist(), strict=True
    ):
        yield key, texts[at : at + size]
        at += size


def packed_firsts(firsts: DataFrame, buckets: int) -> DataFrame:
    """``key, first`` as rows of kind 2 by the bucket of the key."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                arrays = [np.asarray(c).astype(np.int64) for c in batch.columns]
                yield _rows(_by_text(arrays, FIRST, buckets, 2))

    return firsts.select("key", "first").mapInArrow(send, PACKED)


def _dealt(packed: DataFrame, buckets: int) -> DataFrame:
    """Each bucket in one task, which meets its buckets one after the other."""
    return packed.repartition(-(-buckets // FINE), "bucket").sortWithinPartitions("bucket")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Each bucket of a task with its ``(kind, data)`` rows."""
    here, rows = None, []
    for batch in batches:
        columns = batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("data")
        for bucket, kind, data in zip(*columns, strict=True):
            if bucket != here and rows:
                yield here, rows
                rows = []
            here = bucket
            rows.append((kind, data.as_py()))
    if rows:
        yield here, rows


def _read(rows: list[tuple[int, bytes]], types: tuple[str, ...], kind: int = 1) -> list[np.ndarray]:
    """The arrays of ``kind`` in a bucket, as longs sorted by the first."""
    parts = [_parted(d, len(types)) for k, d in rows if k == kind]
    columns = [
        np.frombuffer(b"".join(p[c] for p in parts), t).astype(np.int64) for c, t in enumerate(types)
    ]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _packs(rows: list[tuple[int, bytes]]) -> list[bytes]:
    """The packed texts of a bucket, still compressed."""
    return [data for kind, data in rows if not kind]


def _of(keys: np.ndarray, key: int) -> slice:
    return slice(int(np.searchsorted(keys, key)), int(np.searchsorted(keys, key, side="right")))


def _strings(pieces: dict[bytes, tuple], hot: set[int], gone: list, buckets: int) -> dict[bytes, tuple]:
    """``pieces`` with those at hot anchors replaced by their strings, the first of equal ones."""
    out: dict[bytes, tuple] = {}
    for piece, (doc, key, start, anchor, count, lead) in pieces.items():
        if anchor not in hot:
            out[piece] = (doc, key, start, anchor, count, lead)
            continue
        for i in range(count):
            string = piece[i : i + WIDTH]
            new = (doc, key, start + i, _anchor(xxhash.xxh3_64_intdigest(string), buckets), 1, 0)
            old = out.get(string)
            if old is None or new[:3] < old[:3]:
                out[string] = new
            else:
                old = new
            # The later of two equal strings goes; a piece of one string may be the other one.
            if old is not None:
                gone.append((old[1], old[2], old[4]))
    return out


def segments(texts: DataFrame, marks: DataFrame, firsts: DataFrame, buckets: int) -> DataFrame:
    """The segments at repeated anchors, packed by bucket of the anchor (kind 0), and what is settled.

    Of equal segments in one task the first goes on; the others are rows of kind
    1 in the bucket of their text, with columns as in ``LOSS``. Segments at a hot
    anchor go on as single strings, dealt by what they say, so that no owner meets
    all texts that hold one line.

    Texts are taken in order of their keys, so that a task that runs twice settles
    the same segments, in whatever order its rows arrive.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        first_of: dict[bytes, tuple] = {}
        gone: list[tuple[int, int, int]] = []
        hot: set[int] = set()
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            cells = list((_strings(first_of, hot, gone, buckets) if hot else first_of).items())
            first_of.clear()
            rows = []
            if cells:
                heads = np.array([(c[3], *c[:3], *c[4:]) for _, c in cells], dtype=np.int64)
                bucket = (heads[:, 0] >> 32).astype(np.int32)
                heads[:, 0] &= LOW
                for b, (place, head) in _split(bucket, np.arange(len(cells)), heads):
                    columns = [head[:, c].astype(t).tobytes() for c, t in enumerate(HEAD)]
                    body = b"".join(cells[i][0] for i in place.tolist())
                    rows.append((b, 0, squeeze.compress(_joined(*columns, body))))
            if gone:
                table = np.array(gone, dtype=np.int64)
                gone.clear()
                rows += _by_text(list(table.T), LOSS, buckets, 1)
            yield _rows(rows)

        for _, found_rows in _by_bucket(batches):
            names, high, low, often = _read(found_rows, MARK)
            marked = (high << 32) | low
            owners, first_docs = _read(found_rows, FIRST, kind=2)
            wanted: dict[int, bytes] = {}
            for data in _packs(found_rows):
                for key, text in _unpack_texts(data):
                    own = _of(names, key & LOW)
                    if own.start < own.stop:
                        wanted.setdefault(key, text)
            del found_rows
            by_key = sorted(wanted.items())
            del wanted
            found = anchors([t for _, t in by_key])
            for (key, text), (hashes, starts, counts, leads) in zip(by_key, found, strict=True):
                own = _of(names, key & LOW)
                named = _anchor(hashes, buckets).astype(np.int64)
                mine = np.isin(named, marked[own])
                hot.update(marked[own][often[own] > 0].tolist())
                doc = int(first_docs[np.searchsorted(owners, key)])
                columns = (named[mine], starts[mine], counts[mine], leads[mine])
                for anchor, start, count, lead in zip(*(c.tolist() for c in columns), strict=True):
                    piece = text[start : start + count + WIDTH - 1]
                    new = (doc, key, start, anchor, count, lead)
                    old = first_of.get(piece)
                    if old is None:
                        first_of[piece] = new
                        held += len(piece) * (count if anchor in hot else 1) + CELL
                    else:
                        held += CELL
                        if new[:3] < old[:3]:
                            first_of[piece] = new
                            gone.append((old[1], old[2], old[4]))
                        else:
                            gone.append((key, start, count))
                    if held > HELD:
                        yield from flush()
                        held = 0
        yield from flush()

    both = texts.union(marks).union(packed_firsts(firsts, buckets))
    return _dealt(both, buckets).mapInArrow(cut, PACKED)


def longest_previous(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix.

    ``order`` has the text places of the suffixes in suffix order, ``common[i]``
    the common prefix of suffixes i and i - 1. The match that starts earlier is at
    the previous or the next smaller place in suffix order; a stack finds both.
    """
    places, lengths = order.tolist(), common.tolist()
    found = [0] * len(places)
    stack: list[tuple[int, int]] = []  # index and common prefix with what lies below it
    for i in range(len(places) + 1):
        now = lengths[i] if i < len(places) else 0
        place = places[i] if i < len(places) else -1
        while stack and places[stack[-1][0]] > place:
            top, before = stack.pop()
            found[top] = max(before, now)
            now = min(now, before)
        if i < len(places):
            stack.append((i, now))
    return np.array(found, dtype=np.int64)


def _settle(cells: list[tuple], texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """``key, start, strings`` that go, from the different segments at one anchor.

    A cell is ``(doc, key, start, strings, lead)``, in order of the first three.
    Equal strings have the anchor at the same place in them, so strings are taken
    by that place, as many places at a time as fit.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    begins = np.cumsum([0, *(len(t) for t in texts[:-1])])
    counts = np.array([c[3] for c in cells])
    owner = np.repeat(np.arange(len(cells)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    lead = np.array([c[4] for c in cells])[owner] - offset
    longest = np.empty(len(owner), dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(data, WIDTH)
    by_lead = np.argsort(lead, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(lead[by_lead])) + 1, len(lead))
    at = 0
    while at < len(lead):
        fits = ends[(ends > at) & (ends <= at + SORTED)]
        end = int(fits[-1]) if len(fits) else int(ends[np.searchsorted(ends, at, side="right")])
        place = np.sort(by_lead[at:end])
        longest[place] = _factors(place, views[begins[owner[place]] + offset[place]])
        at = end
    goes = np.flatnonzero(longest >= WIDTH)
    if not len(goes):
        return
    new = np.ones(len(goes), dtype=bool)
    new[1:] = (owner[goes[1:]] != owner[goes[:-1]]) | (offset[goes[1:]] != offset[goes[:-1]] + 1)
    runs = np.flatnonzero(new)
    for r, length in zip(runs.tolist(), np.diff(runs, append=len(goes)).tolist(), strict=True):
        _, key, start, *_ = cells[owner[goes[r]]]
        yield key, start + int(offset[goes[r]]), length


def _factors(place: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Longest previous factors, up to ``WIDTH``, of strings given in the order of their places."""
    order = np.argsort(np.ascontiguousarray(strings).view(f"S{WIDTH}").ravel(), kind="stable")
    lined = strings[order]
    differ = lined[1:] != lined[:-1]
    common = np.zeros(len(order), dtype=np.int64)
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
    longest = np.empty(len(order), dtype=np.int64)
    longest[order] = longest_previous(place[order], common)
    return longest


def settled(cut: DataFrame, buckets: int) -> DataFrame:
    """What goes, as rows of kind 1 by bucket of the text: what ``cut`` settled, and the owners' part."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: list[tuple[int, int, int]] = []

        def rows() -> pa.RecordBatch:
            table = np.array(gone, dtype=np.int64).reshape(-1, 3)
            gone.clear()
            return _rows(_by_text(list(table.T), LOSS, buckets, 1))

        for bucket, packed in _by_bucket(batches):
            yield _rows([(bucket, kind, data) for kind, data in packed if kind])
            squeeze = zstandard.ZstdDecompressor()
            parts = [_parted(squeeze.decompress(data), len(HEAD) + 1) for data in _packs(packed)]
            del packed
            head = np.column_stack(
                [np.frombuffer(b"".join(p[c] for p in parts), t).astype(np.int64) for c, t in enumerate(HEAD)]
            )
            body = b"".join(p[-1] for p in parts)
            del parts
            ends = np.cumsum(head[:, 4] + WIDTH - 1)
            order = np.lexsort((head[:, 3], head[:, 2], head[:, 1], head[:, 0]))
            cuts = np.flatnonzero(np.diff(head[order, 0])) + 1
            for group in np.split(order, cuts):
                if len(group) < 2:
                    continue
                firsts: dict[bytes, tuple] = {}
                for i in group.tolist():  # in order of doc, key and start
                    _, doc, key, start, count, lead = head[i].tolist()
                    piece = body[ends[i] - count - WIDTH + 1 : ends[i]]
                    if piece in firsts:
                        gone.append((key, start, count))
                    else:
                        firsts[piece] = (doc, key, start, count, lead)
                if len(firsts) > 1:
                    gone.extend(_settle(list(firsts.values()), list(firsts)))
                if len(gone) > 1 << 16:
                    yield rows()
        yield rows()

    return _dealt(cut, buckets).mapInArrow(own, PACKED)


def cut_out(texts: DataFrame, gone: DataFrame, buckets: int) -> DataFrame:
    """``key, n_removed, n_spans, kept, kept_sha256`` of each text that loses bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            yield from cut_bucket(rows)

    def cut_bucket(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        packs = _packs(rows)
        keys, starts, counts = _read(rows, LOSS)
        seen: set[int] = set()
        for data in packs:
            out = []
            for key, text in _unpack_texts(data):
                own = _of(keys, key)
                if key in seen or own.start == own.stop:
                    continue
                seen.add(key)
                order = np.argsort(starts[own], kind="stable")
                first = starts[own][order]
                last = np.maximum.accumulate(first + counts[own][order] + WIDTH - 1)
                new = np.ones(len(first), dtype=bool)
                new[1:] = first[1:] > last[:-1]
                runs = np.flatnonzero(new)
                begin, end = first[runs].tolist(), last[np.append(runs[1:] - 1, len(first) - 1)].tolist()
                digest, at = hashlib.sha256(), 0
                for b, e in zip(begin, end, strict=True):
                    digest.update(text[at:b])
                    at = e
                digest.update(text[at:])
                spans = [[b, e] for b, e in zip(begin, end, strict=True)]
                out.append((key, sum(e - b for b, e in spans), len(spans), spans, digest.hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string())
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["key", "n_removed", "n_spans", "removed", "kept_sha256"],
            )

    both = texts.union(gone)
    return _dealt(both, buckets).mapInArrow(
        cut, "key long, n_removed long, n_spans long, removed array<array<long>>, kept_sha256 string"
    )


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array([text_key(t) for t in texts], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            ],
            names=["doc_id", "key", "n_bytes", "sha"],
        )


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, removed, kept_sha256``.

    ``removed`` has the ``[start, end)`` byte ranges that go.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    buckets = FINE * partitions(docs)
    thin = pin(docs.mapInArrow(_thin, "doc_id long, key long, n_bytes long, sha string"))
    firsts = thin.groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("first"))
    texts = packed_texts(docs, buckets)
    gone = settled(segments(texts, repeated_anchors(docs), firsts, buckets), buckets)
    losses = cut_out(texts, gone, buckets)
    joined = thin.join(firsts, "key").join(losses, "key", "left")
    copy = (F.coalesce("doc_id", F.lit(LAST)) != F.col("first")) & (F.col("n_bytes") >= WIDTH)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes"))))
        .otherwise(F.coalesce("removed", F.array().cast("array<array<bigint>>")))
        .alias("removed"),
        F.when(copy, none).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
