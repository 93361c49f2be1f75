"""Repeated fixed-length windows over all documents, found by rolling hashes.

A document is a sequence of units (words or lines), each hashed to 64 bits.
Every window of ``width`` units gets a Rabin-Karp hash: a polynomial of its unit
hashes, rolled by one prefix sum.  Two independent polynomials are kept: one
picks the bucket, 56 bits of the other identify the window inside its bucket.

Windows are counted in two steps.  A worker first counts them in a block of
half a million: of the copies inside a block only those of the smallest
document (or the first copy) go on, so a window sends one document per block
however often it occurs.  The second step meets all blocks' entries of a bucket.
The number of buckets grows with the input, so that each holds a bounded number
of windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from . import common

BLOCK_WINDOWS = 1 << 19
#: Bytes of the plan's size estimate for each bucket: about one and a half million windows of words.
BUCKET_BYTES = 2 << 20

_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)

# A row of entries, all of rows with an id or all of rows without one: for each document its id (steps between
# ordered ids), its text's key, how many windows and their positions (steps), and for each window its hash.
_ENTRY = [("none", pa.bool_()), *((c, pa.binary()) for c in ("doc_id", "text", "count", "pos", "hash"))]
_ENTRY_DDL = "none boolean, doc_id binary, text binary, count binary, pos binary, hash binary"
_SENT, _SENT_DDL = pa.schema([("bucket", pa.int64()), *_ENTRY, ("marked", pa.bool_())]), f"bucket long, {_ENTRY_DDL}, marked boolean"
_MARKS, _MARKS_DDL = pa.schema([("part", pa.int64()), *_ENTRY]), f"part long, {_ENTRY_DDL}"
#: Bytes of a window's hash that its mark keeps, to tell apart documents that share a key.
MARK_BYTES = 4
#: Bytes of the plan's size estimate for each part of the documents.
PART_BYTES = 4 << 20


def rolling(units: np.ndarray, width: int, lane: int) -> np.ndarray:
    """The hash of every window of ``width`` consecutive unit hashes."""
    n = len(units) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        base = np.uint64(_BASES[lane])
        inverse = np.uint64(pow(_BASES[lane], -1, 1 << 64))
        grown = np.full(len(units), base, np.uint64)
        grown[0] = 1
        grown = np.cumprod(grown, dtype=np.uint64)
        shrunk = np.full(n, inverse, np.uint64)
        shrunk[0] = 1
        shrunk = np.cumprod(shrunk, dtype=np.uint64)
        total = np.zeros(len(units) + 1, np.uint64)
        np.cumsum((common.mix(units ^ np.uint64(0xA5A5A5A5A5A5A5A5)) if lane else units) * grown, out=total[1:])
        return common.mix((total[width:] - total[:-width]) * shrunk)


def _ordered_ids(ids: np.ndarray) -> np.ndarray:
    """Signed ids as unsigned numbers in the same order."""
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def text_bits(doc_id: int | None, raw: bytes, by_document: bool) -> int:
    """What tells a row's text apart: 64 bits of it, or 16 if rows that share an id need no telling apart."""
    return xxhash.xxh3_64_intdigest(raw) & (0xFFFF if by_document and doc_id is not None else 0xFFFFFFFFFFFFFFFF)


class _Entries(NamedTuple):
    """Windows, each with its row's missing id, ordered id and text key, its position and its hash."""

    none: np.ndarray
    ids: np.ndarray
    text: np.ndarray
    at: np.ndarray
    hash: np.ndarray

    def take(self, which: np.ndarray) -> _Entries:
        return _Entries(*(column[which] for column in self))

    def same_row(self, other: _Entries) -> np.ndarray:
        return (self.none == other.none) & (self.ids == other.ids) & (self.text == other.text)

    def starts(self) -> np.ndarray:
        """Where another row begins, in entries ordered by row."""
        return _starts(self.none, self.ids, self.text)

    def packed(self, key: np.ndarray, planes: int, ordered: bool = False) -> Iterator[tuple]:
        """(key, none, packed columns) for each key's entries with and without an id; ``ordered`` by row and position, or not yet."""
        order = np.argsort(key, kind="stable") if ordered else np.lexsort((self.at, self.text, self.ids, self.none, key))
        key, own = key[order], self.take(order)
        begins = np.flatnonzero(_starts(key, own.none))
        for a, b in zip(begins.tolist(), np.append(begins, len(key))[1:].tolist(), strict=True):
            part = own.take(slice(a, b))
            rows = np.flatnonzero(part.starts())
            steps = np.diff(part.at, prepend=0)
            steps[rows] = part.at[rows]
            there = part.ids[rows]
            columns = common.pack(np.concatenate([there[:1], np.diff(there)])), common.pack(part.text[rows]), common.pack(np.diff(np.append(rows, b - a))), common.pack(steps), common.pack(part.hash, planes)
            yield int(key[a]), bool(part.none[0]), *columns

    @classmethod
    def read(cls, rows: Iterable[dict]) -> _Entries:
        found = [cls._one(row) for row in rows]
        if not found:
            return cls(np.empty(0, bool), *(np.empty(0, np.uint64) for _ in range(2)), np.empty(0, np.int32), np.empty(0, np.uint64))
        return cls(*map(np.concatenate, zip(*found, strict=True)))

    @classmethod
    def _one(cls, row: dict) -> _Entries:
        ids, text, counts = np.cumsum(common.unpack(row["doc_id"]), dtype=np.uint64), common.unpack(row["text"]), common.unpack(row["count"]).astype(np.int64)
        total = np.cumsum(common.unpack(row["pos"]).astype(np.int64))
        before = np.concatenate([[0], total])[np.cumsum(counts) - counts]
        at = (total - np.repeat(before, counts)).astype(np.int32)
        return cls(np.full(len(at), row["none"]), np.repeat(ids, counts), np.repeat(text, counts), at, common.unpack(row["hash"]))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it in any column."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for column in columns:
        out[1:] |= column[1:] != column[:-1]
    return out


def _first_of_run(new: np.ndarray) -> np.ndarray:
    return np.flatnonzero(new)[np.cumsum(new) - 1]


class _Block:
    """Windows of some documents, waiting to be counted."""

    def __init__(self, width: int, n_buckets: int, by_document: bool):
        self.width, self.n_buckets, self.by_document = width, n_buckets, by_document
        self.docs: list[tuple[int | None, int, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc_id: int | None, text: int, units: np.ndarray) -> None:
        place, check = rolling(units, self.width, 0), rolling(units, self.width, 1)
        self.docs.append((doc_id, text, place, check))
        self.size += len(place)

    def flush(self) -> Iterator[tuple]:
        if not self.size:
            self.docs = []
            return
        docs = sorted(self.docs, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
        lengths = np.array([len(d[2]) for d in docs])
        place, check = np.concatenate([d[2] for d in docs]), np.concatenate([d[3] for d in docs])
        which = np.repeat(np.arange(len(docs), dtype=np.int32), lengths)
        at = (np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        none, ids, text = np.array([d[0] is None for d in docs]), _ordered_ids(np.array([d[0] or 0 for d in docs], np.int64)), np.array([d[1] for d in docs], np.uint64)
        self.docs, self.size = [], 0
        check &= np.uint64((1 << 56) - 1)
        order = np.argsort(check, kind="stable")  # within equal hashes by document and position
        first = order[_first_of_run(_starts(check[order]))]
        a, b = which[order], which[first]
        later = (none[a] != none[b]) | (ids[a] != ids[b])
        if not self.by_document:
            later |= (text[a] != text[b]) | (at[order] != at[first])
        mine = np.zeros(len(which), bool)
        mine[order[later]] = True
        for marked in (True, False):  # those found inside the block are dealt by document, only to be passed on
            take = np.flatnonzero(mine if marked else ~mine)
            rows = which[take]
            bucket = (common.mix(ids[rows] + text[rows]) if marked else place[take]) % np.uint64(self.n_buckets)
            entries = _Entries(none[rows], ids[rows], text[rows], at[take], check[take])
            for row in entries.packed(bucket.astype(np.int64), MARK_BYTES if marked else 7, True):
                yield *row, marked


def part_of(ids: np.ndarray, text: np.ndarray, n_parts: int) -> np.ndarray:
    """The part to which a document is dealt; ``ids`` as unsigned ordered numbers."""
    return (common.mix(ids + text) % np.uint64(n_parts)).astype(np.int64)


def _marks(entries: _Entries, n_parts: int) -> Iterator[tuple]:
    """Rows of marks, one or two for each part of the documents."""
    return entries.packed(part_of(entries.ids, entries.text, n_parts), MARK_BYTES)


def _count(group: pa.Table, by_document: bool, n_parts: int) -> Iterator[tuple]:
    """Meet the entries of a bucket: mark those whose window occurs earlier."""
    pa.set_memory_pool(pa.system_memory_pool())
    rows = [r for batch in group.to_batches(8) for r in batch.to_pylist()]
    for row in rows:
        if row["marked"]:
            yield from _marks(_Entries.read([row]), n_parts)
    own = _Entries.read(r for r in rows if not r["marked"])
    del rows
    order = np.argsort(own.hash, kind="stable")
    s = own.hash[order]
    same = s[1:] == s[:-1]
    several = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(s) else np.empty(0, bool)
    own = own.take(order[several])  # most windows occur once
    own = own.take(np.lexsort((own.at, own.text, own.ids, own.none, own.hash)))
    first = own.take(_first_of_run(_starts(own.hash)))
    if by_document:
        later = (own.none != first.none) | (own.ids != first.ids)
    else:
        later = ~own.same_row(first) | (own.at != first.at)
    yield from _marks(own.take(later), n_parts)


def repeated(docs: DataFrame, units_of: Callable[[bytes], np.ndarray], width: int, by_document: bool, n_parts: int) -> DataFrame:
    """Windows that occur earlier, as packed rows for each of ``n_parts`` parts of the documents.

    ``docs`` has the columns doc_id and text.  With ``by_document`` a window is
    marked if it also starts in a document with a smaller id; otherwise if any
    copy of it comes before, by document id and then position.  A missing id is
    a flag of its own and comes after all ids.
    """
    n_buckets = common.buckets_for(docs, BUCKET_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(width, n_buckets, by_document)

        def rows() -> Iterator[tuple]:
            for doc_id, raw in common.texts(batches):
                block.add(doc_id, text_bits(doc_id, raw, by_document), units_of(raw))
                if block.size >= BLOCK_WINDOWS:
                    yield from block.flush()
            yield from block.flush()

        yield from common.batches(rows(), _SENT, 64)

    def meet(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(common.batches(_count(group, by_document, n_parts), _MARKS)), _MARKS)

    return docs.mapInArrow(send, _SENT_DDL).groupBy("bucket").applyInArrow(meet, _MARKS_DDL)


def covered(n_units: int, at: np.ndarray, width: int) -> np.ndarray:
    """Which of a text's units lie in a window that starts at one of ``at``."""
    change = np.zeros(n_units + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + width, n_units), -1)
    return np.cumsum(change[:-1]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of true values, as (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def without_repeats(
    docs: DataFrame, units_of: Callable[[bytes], np.ndarray], width: int, by_document: bool, cut: Callable[[int | None, bytes, np.ndarray | None], tuple], schema: pa.Schema, ddl: str
) -> DataFrame:
    """Apply ``cut`` to every document row with its marked windows' positions.

    ``docs`` has the columns doc_id, text and rest, a string that is carried to
    the end of the row that ``cut`` makes.  Documents and marks are dealt to the
    same parts by a hash of id and text key; texts travel compressed.  Where
    different texts share a key, a mark counts only for a text whose own window
    at that place has the mark's hash.
    """
    n_parts = common.buckets_for(docs, PART_BYTES, 64)
    marks = repeated(docs.select("doc_id", "text"), units_of, width, by_document, n_parts)
    small = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("full", pa.int64()), ("packed", pa.binary()), ("rest", pa.string())])
    schema, ddl = schema.append(pa.field("rest", pa.string())), f"{ddl}, rest string"

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        signed = lambda value: value - (value >> 63 << 64)

        def rows() -> Iterator[tuple]:
            for doc_id, raw, rest in common.texts(batches):
                key, full = text_bits(doc_id, raw, by_document), text_bits(None, raw, by_document)
                part = part_of(_ordered_ids(np.array([doc_id or 0])), np.array([key], np.uint64), n_parts)
                yield int(part[0]), doc_id, signed(key), signed(full), squeeze.compress(raw), rest

        return common.batches(rows(), small, 512)

    def marks_of(marked: pa.Table) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
        """Positions and hashes by (id, text key)."""
        own = _Entries.read(marked.to_pylist())
        own = own.take(np.lexsort((own.at, own.text, own.ids, own.none)))
        begins = np.flatnonzero(own.starts())
        ends = np.append(begins, len(own.at))[1:].tolist()
        ids = (own.ids[begins] ^ np.uint64(1 << 63)).view(np.int64).tolist()
        keys = zip(own.none[begins].tolist(), ids, own.text[begins].view(np.int64).tolist(), strict=True)
        return {(None if none else i, t): (own.at[a:b], own.hash[a:b]) for (none, i, t), a, b in zip(keys, begins.tolist(), ends, strict=True)}

    def meet(own: pa.Table, marked: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        expand, found, texts = zstandard.ZstdDecompressor(), marks_of(marked), {}
        for doc_id, key, full in zip(*(own[c].to_pylist() for c in ("doc_id", "key", "full")), strict=True):
            if (doc_id, key) in found:
                texts.setdefault((doc_id, key), set()).add(full)

        def positions(doc_id: int | None, key: int, raw: bytes) -> np.ndarray | None:
            if (doc_id, key) not in found:
                return None
            at, check = found[doc_id, key]
            if len(texts[doc_id, key]) > 1:
                mine = rolling(units_of(raw), width, 1) & np.uint64((1 << 8 * MARK_BYTES) - 1)
                inside = at < len(mine)
                at, check = at[inside], check[inside]
                at = at[mine[at] == check]
            return at

        def rows() -> Iterator[tuple]:
            for batch in own.to_batches(64):
                for _, doc_id, key, _, packed, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    raw = expand.decompress(packed)
                    yield *cut(doc_id, raw, positions(doc_id, key, raw)), rest

        return pa.Table.from_batches(list(common.batches(rows(), schema, 256)), schema)

    held = docs.mapInArrow(shrink, "part long, doc_id long, key long, full long, packed binary, rest string")
    return held.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(meet, ddl)
