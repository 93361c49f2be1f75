"""Substring dedup: passages that an earlier document already holds are removed."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, windows

#: What stands between words: space and the ASCII controls 9 to 13.
SPACE = b" \t\n\x0b\x0c\r"


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash for each word of a text."""
    parts = []
    for piece in common.slices(raw, SPACE):
        words = piece.split()  # bytes.split() cuts at exactly SPACE
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])
_OUT_DDL = "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_text string"
def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """Remove every word covered by a ``width``-word window that also starts in a document with a smaller id.

    Returns (doc_id, n_words, n_removed, removed, kept_text), one row per input
    row: ``removed`` lists the maximal removed word intervals [start, end),
    ``kept_text`` the kept words joined by one space.

    Windows are judged on the input, never on what is left after other
    removals.  A null or empty text has no words; one shorter than ``width``
    loses nothing.  Rows with a null id count as coming after all others and
    have no smaller one among themselves.  Rows that share an id never remove
    words from each other, whether their texts are equal or not; each is judged
    against the smaller ids on its own.  Other columns of ``docs`` are not read.
    Two windows are taken as equal if 56 bits of one rolling hash and the bucket
    chosen by another agree: of the millions of windows in a bucket one differs
    unnoticed about once in 10^10.
    """
    rows = common.id_and_text(docs, id_col, text_col)

    def cut(doc_id: int | None, raw: bytes, at: np.ndarray | None) -> tuple:
        pieces = list(common.slices(raw, SPACE))
        sizes = [len(piece.split()) for piece in pieces]
        mask = np.zeros(sum(sizes), bool) if at is None else windows.covered(sum(sizes), at, width)
        kept, begin = [], 0
        for piece, size in zip(pieces, sizes, strict=True):
            gone = mask[begin : begin + size]
            begin += size
            if not gone.all():
                kept.append(b" ".join(itertools.compress(piece.split(), (~gone).tolist())))
        return doc_id, len(mask), int(mask.sum()), [{"start": a, "end": b} for a, b in windows.intervals(mask)], b" ".join(kept).decode()

    return windows.without_repeats(rows.withColumn("rest", F.lit("")), word_hashes, width, True, cut, _OUT, _OUT_DDL).drop("rest")
