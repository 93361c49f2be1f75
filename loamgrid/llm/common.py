"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid import lineage

#: Bytes of text handled at a time inside a worker.
SLICE_BYTES = 1 << 20


def written(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back: lineage ends there."""
    return lineage.fixed(frame)


def buckets_for(frame: DataFrame, bytes_each: int, least: int = 32, most: int = 1 << 22) -> int:
    """A bucket count that follows the plan's size estimate (file sizes for scans).

    A plan without an estimate is measured instead: one pass counts its bytes.
    Beyond ``most`` buckets they grow with the input.
    """
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:
        size = frame.agg(F.sum(8 + sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in frame.columns))).first()[0] or 0
    return max(least, min(most, -(-size // bytes_each)))


def texts(batches: Iterable[pa.RecordBatch], rows: int = 128) -> Iterator[tuple]:
    """(id, text as UTF-8, other columns...) of batches, a few rows in memory at a time."""
    pa.set_memory_pool(pa.system_memory_pool())  # gives freed memory back; an executor's workers share little
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            columns = [part.column(1).cast(pa.binary()) if k == 1 else part.column(k) for k in range(part.num_columns)]
            yield from zip(*(c.to_pylist() for c in columns), strict=True)


def slices(raw: bytes, separators: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """Cut a long text after separators, so that no token is split."""
    if len(raw) <= size:
        yield raw
        return
    separator, start = re.compile(b"[" + re.escape(separators) + b"]"), 0
    while len(raw) - start > size and (cut := separator.search(raw, start + size)):
        yield raw[start : cut.start()]
        start = cut.start()
    yield raw[start:]


def pack(values: np.ndarray, planes: int = 0) -> bytes:
    """Non-negative integers as byte planes; high planes are mostly zero and compress."""
    values = np.ascontiguousarray(values, dtype="<u8")
    if not planes:
        planes = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    raw = values.view(np.uint8).reshape(-1, 8)[:, :planes]
    return bytes([planes]) + np.ascontiguousarray(raw.T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    planes = raw[0]
    flat = np.frombuffer(raw, np.uint8, offset=1).reshape(planes, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :planes] = flat.T
    return out.view("<u8").ravel()


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the smallest node of each one's component."""
    label = np.arange(n, dtype=np.int64)
    while len(left):
        a, b = label[left], label[right]
        differ = a != b
        if not differ.any():
            break
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def id_and_text(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under its own names; a null text is empty.

    Spark bounds the bytes of an Arrow batch (64 MB), so long texts need no setting.
    """
    return frame.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_key(*columns: Column) -> Column:
    """128 bits of a text or of several columns, which tell apart rows that share an id or have none."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))
