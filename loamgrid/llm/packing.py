"""Best-fit packing of tokenised documents into sequences, by vector best-fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Documents that one packing task takes together.
GROUP_DOCS = 8192

_PIECES = pa.schema([("doc_id", pa.int64()), ("crc", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES_DDL = "doc_id long, crc long, piece int, start long, length long, ids_crc32 long"
_PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PLACED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Encoder:
    """Ids of a byte-level BPE tokenizer.

    The ids are those of the ``tokenizers`` file.  Its vocabulary's ranks, given
    beside it, let ``tiktoken`` find the same ids about four times as fast; a
    text that holds a special token's string goes to ``tokenizers`` itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_encoders: dict[tuple, Encoder] = {}


def _encoder(*key) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def cuts(total: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than ``most``."""
    if total <= most:
        return [(0, total)]
    first = total % most or most
    return [(0, first), *((at, most) for at in range(first, total, most))]


def vector_best_fit(demands: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """The bin of each item; no bin exceeds ``capacity`` in any dimension.

    Items go in by falling weighted size.  Of the open bins that can take one,
    "norm" chooses the one with the least weighted norm of what is left after
    it, "dot" the largest weighted dot product of what is left before it with
    the item.  Ties go to the oldest bin; a new bin opens if none fits.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"no such rule: {rule}")
    scaled, n = demands / capacity, len(demands)
    if n and (scaled > 1).any():
        raise ValueError("an item exceeds an empty bin")
    order = np.argsort(-(scaled * weights).sum(1), kind="stable")
    left, open_bins, bins = np.empty((n, demands.shape[1])), np.empty(0, np.int64), np.empty(n, np.int64)
    used, least = 0, scaled.min(0) if n else None
    for k, item in enumerate(order.tolist()):
        need = scaled[item]
        room = left[open_bins]
        fits = np.flatnonzero((room >= need - 1e-12).all(1))
        if len(fits):
            there = room[fits]
            score = (weights * (there - need) ** 2).sum(1) if rule == "norm" else -(weights * there * need).sum(1)
            b = int(open_bins[fits[np.argmin(score)]])
            left[b] -= need
        else:
            b, used = used, used + 1
            left[b] = 1 - need
            open_bins = np.append(open_bins, b)
        bins[item] = b
        if (left[b] < least - 1e-12).any() or k % 512 == 511:  # full for whatever comes
            open_bins = open_bins[(left[open_bins] >= least - 1e-12).all(1)]
    return bins


def pack_sequences(
    docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", separator: int = 0, most_tokens: int = 2048,
    most_documents: int | None = None, most_attention: float | None = None, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm",
) -> DataFrame:
    """Pack all documents into sequences of at most ``most_tokens`` tokens.

    A document is its ids followed by ``separator``.  One longer than a sequence
    is cut into pieces of which only the first may be shorter; no other is cut.
    Besides tokens a sequence has room for ``most_documents`` pieces and for
    ``most_attention`` (the sum of squared lengths); None sets what no sequence
    can exceed.  Returns (doc_id, piece, start, length, ids_crc32, sequence_id,
    offset): a row for each piece, its place in its document and its sequence,
    where pieces follow without gaps.

    Documents are dealt by a hash into groups of about ``GROUP_DOCS``, each packed
    by itself, so that a sequence or two in a group stay partly empty.  A null or
    empty text is the separator alone.  A null id is kept.  Repeated rows are
    packed each on its own.  Other columns of ``docs`` are not read.
    """
    rows = common.id_and_text(docs, id_col, text_col)
    n_groups = max(1, round(docs.count() / GROUP_DOCS))
    key = (tokenizer_path, ranks_path, pattern)
    capacity = np.array([most_tokens, most_documents or most_tokens, most_attention or float(most_tokens) ** 2], float)
    if capacity[2] < float(most_tokens) ** 2:
        raise ValueError("most_attention is below what one full piece costs")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*key)

        def out() -> Iterator[tuple]:
            for doc_id, text in common.texts(batches):
                ids = np.array([*encoder.ids(text.decode()), separator], "<u4")
                raw = ids.tobytes()
                crc = zlib.crc32(raw)
                for piece, (start, length) in enumerate(cuts(len(ids), most_tokens)):
                    yield doc_id, crc, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])

        return common.batches(out(), _PIECES)

    def place(keys: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("crc", "ascending"), ("piece", "ascending")])
        length = group["length"].to_numpy().astype(float)
        bins = vector_best_fit(np.stack([length, np.ones(len(length)), length**2], 1), capacity, np.array(weights), rule)
        order = np.argsort(bins, kind="stable")
        b, long = bins[order], group["length"].to_numpy()[order]
        before = np.cumsum(long) - long
        begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        offset = np.empty(len(b), np.int64)
        offset[order] = before - np.repeat(before[begin], np.diff(np.append(begin, len(b))))
        numbers = (keys[0].as_py() << 32) + bins
        return pa.Table.from_arrays([*(group[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(numbers), pa.array(offset)], schema=_PLACED)

    pieces = rows.mapInArrow(tokenise, _PIECES_DDL).withColumn("group", F.pmod(F.xxhash64("doc_id", "crc"), F.lit(n_groups)))
    return pieces.groupBy("group").applyInArrow(place, _PLACED_DDL)
