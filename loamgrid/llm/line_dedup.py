"""Line dedup: later occurrences of three-line windows are removed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, windows

_SPACE = b" \t\n\x0b\x0c\r"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
_OUT_DDL = "doc_id long, n_lines long, n_removed long, kept_text string"


def line_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash for each line that is not blank; the line's ends are trimmed."""
    parts = []
    for piece in common.slices(raw, b"\n"):
        lines = [x for line in piece.split(b"\n") if (x := line.strip(_SPACE))]
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def cut_lines(raw: bytes, at: np.ndarray | None, width: int) -> tuple[bytes, int, int]:
    """The text without the lines under marked windows, its lines with a word, and how many went."""
    lines = raw.split(b"\n")
    full = [k for k, line in enumerate(lines) if line.strip(_SPACE)]
    if at is None:
        return raw, len(full), 0
    mask = windows.covered(len(full), at, width).tolist()
    gone = {k for k, out in zip(full, mask, strict=True) if out}
    return b"\n".join(line for k, line in enumerate(lines) if k not in gone), len(full), len(gone)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove the lines under every window of ``width`` consecutive lines that occurs earlier.

    Returns (doc_id, n_lines, n_removed, kept_text) and the columns named in
    ``carry`` (strings, numbers or booleans), one row per input row.
    Windows run over the lines with a character other than space and ASCII 9 to
    13, compared without such characters at their ends; blank lines lie in no
    window and stay.  The first occurrence of a window, by document id and then
    position, stays, in the same document too; the lines under all others merge
    into one covered set and go.  Windows are judged on the input.

    A null or empty text has no lines and is returned as the empty text.  Rows
    with a null id come after all others.  Identical repeated rows (same id, or
    none, and same text) are one document and are treated alike; rows with the
    same id, or none, and different texts come in the order of 64-bit hashes of
    their texts.  Other columns of ``docs`` are not read.
    """
    rest = F.to_json(F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)))) if carry else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), rest.alias("rest"))

    def cut(doc_id: int | None, raw: bytes, at: np.ndarray | None) -> tuple:
        text, n, gone = cut_lines(raw, at, width)
        return doc_id, n, gone, text.decode()

    out = windows.without_repeats(rows, line_hashes, width, False, cut, _OUT, _OUT_DDL)
    if not carry:
        return out.drop("rest")
    types = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    held = F.from_json("rest", types)
    return out.select("doc_id", "n_lines", "n_removed", "kept_text", *(held[f"c{k}"].alias(c) for k, c in enumerate(carry)))
