"""SimHash near-dedup by anchor-point covering.

Two 64-bit fingerprints that differ in at most three bits agree up to one bit in
one of their 32-bit halves.  The anchors of a half are a covering code: the
perfect Hamming code of length 31 with the last bit free, of covering radius 1.
A half is listed under every anchor within covering radius plus the half's
threshold, 1 + 1 bits: the anchor nearest to one of two such halves then also
lists the other.  Fingerprints that meet under an anchor are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid import lineage

from . import common
from .components import anew, connected_components

SPACE = b" \t\n\x0b\x0c\r"
SHINGLE = 3
SEED = 42
#: Fingerprints of one anchor that a task compares; longer runs are split into blocks of so many, met two by two.
RUN = 8192
#: Entries (fingerprint under an anchor) that a bucket is meant to hold.
BUCKET_ENTRIES = 1 << 20


def fingerprint(raw: bytes) -> int:
    """The SimHash of a text's shingles; 0 without words."""
    ones, total = np.zeros(64, np.int64), 0
    tail: list[bytes] = []
    for piece in common.slices(raw.lower(), SPACE):  # bytes.lower() changes A-Z alone
        words = tail + piece.split()
        if len(words) < SHINGLE:
            tail = words
            continue
        joined = [b" ".join(x) for x in zip(words, words[1:], words[2:])]
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in joined), np.uint64, len(joined))
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        total += len(joined)
        tail = words[1 - SHINGLE :]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * ones > total).view(np.uint64)[0])


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the changes that lead to an anchor within two bits, and how many they are."""
    free, lists = 1 << 31, []
    bit = lambda position: 1 << (position - 1)  # noqa: E731  positions 1..31 of the Hamming code
    for syndrome in range(32):
        near = bit(syndrome) if syndrome else 0
        pairs = [bit(i) | bit(syndrome ^ i) for i in range(1, 32) if syndrome and i < (syndrome ^ i)]
        lists.append([near, near | free, *pairs])
    count = np.array([len(x) for x in lists])
    table = np.zeros((32, count.max()), np.uint64)
    for k, masks in enumerate(lists):
        table[k, : len(masks)] = masks
    return table, count


_MASKS, _COUNT = _masks()
_SYNDROME = np.zeros((4, 256), np.uint8)
for _place in range(4):
    for _byte in range(256):
        _value = 0
        for _k in range(8):
            if _byte >> _k & 1 and 8 * _place + _k < 31:
                _value ^= 8 * _place + _k + 1
        _SYNDROME[_place, _byte] = _value


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of each 32-bit half under every anchor within two bits."""
    syndrome = np.zeros(len(halves), np.uint8)
    for place in range(4):
        syndrome ^= _SYNDROME[place, (halves >> np.uint64(8 * place) & np.uint64(255)).astype(np.int64)]
    near = halves[:, None] ^ _MASKS[syndrome]
    there = np.arange(_MASKS.shape[1])[None, :] < _COUNT[syndrome][:, None]
    return np.nonzero(there)[0], near[there]


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = common.local_components(n, left, right)
    left = np.flatnonzero(label != np.arange(n))
    return left, label[left]


def links(keys: np.ndarray, prints: np.ndarray, most_bits: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the fingerprints that meet under a key and differ in few bits.

    Rows are compared with the k-th row after them in their key's run, for
    k = 1, 2, ...: nothing larger than the input is held whatever a run's
    length, and links found shrink to a forest as they come.
    """
    nodes, node = np.unique(prints, return_inverse=True)
    order = np.lexsort((prints, keys))
    keys, prints, node = keys[order], prints[order], node[order]
    left, right, k = np.empty(0, np.int64), np.empty(0, np.int64), 1
    at = np.arange(len(keys) - 1)
    while len(at):
        at = at[at + k < len(keys)]
        at = at[keys[at] == keys[at + k]]
        near = at[np.bitwise_count(prints[at] ^ prints[at + k]) <= most_bits]
        left, right = np.append(left, node[near]), np.append(right, node[near + k])
        if len(left) > 2 * len(nodes) + 100_000:
            left, right = _forest(len(nodes), left, right)
        k += 1
    left, right = _forest(len(nodes), left, right)
    return nodes[left], nodes[right]


def links_across(a: np.ndarray, b: np.ndarray, most_bits: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the fingerprints of two blocks that differ in few bits."""
    nodes, node = np.unique(np.concatenate([a, b]), return_inverse=True)
    own, other = node[: len(a)], node[len(a) :]
    left, right = np.empty(0, np.int64), np.empty(0, np.int64)
    for start in range(0, len(a), 128):
        i, j = np.nonzero(np.bitwise_count(a[start : start + 128, None] ^ b[None, :]) <= most_bits)
        left, right = np.append(left, own[start + i]), np.append(right, other[j])
        if len(left) > 2 * len(nodes) + 100_000:
            left, right = _forest(len(nodes), left, right)
    left, right = _forest(len(nodes), left, right)
    return nodes[left], nodes[right]


_CELLS = pa.schema([("bucket", pa.int64()), ("half", pa.int32()), ("prints", pa.binary()), ("anchors", pa.binary())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Links, and the blocks of runs too long for one task: the run's bucket, half and anchor, a block's number and how many there are.
_FOUND = pa.schema([*_LINKS, ("anchor", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("prints", pa.binary())])
_FOUND_DDL = "a long, b long, anchor long, block int, blocks int, prints binary"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp): 128 bits of the text as struct<a, b>, and the fingerprint's 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("fp", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda value: value - (value >> 63 << 64)
        return common.batches(((doc_id, a, b, signed(fingerprint(raw))) for doc_id, raw, a, b in common.texts(batches)), schema)

    rows = common.id_and_text(docs, id_col, text_col).withColumn("key", common.text_key(F.col("text"))).select("doc_id", "text", "key.a", "key.b")
    return rows.mapInArrow(work, "doc_id long, a long, b long, fp long").select("doc_id", F.struct("a", "b").alias("key"), "fp")


def near_links(prints: DataFrame) -> DataFrame:
    """Forest edges (a, b) over distinct fingerprints (column fp) at most three bits apart."""
    n_buckets = max(64, prints.count() * 34 // BUCKET_ENTRIES)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for start in range(0, len(whole), 1 << 17):
                own = whole[start : start + (1 << 17)]
                for half in (0, 1):
                    row, anchor = anchors(own >> np.uint64(32) if half else own & np.uint64(0xFFFFFFFF))
                    bucket = (common.mix(anchor + np.uint64(half << 32)) % np.uint64(n_buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    row, anchor, bucket = row[order], anchor[order], bucket[order]
                    begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
                    ends = np.append(begins[1:], len(bucket)) if len(bucket) else []
                    yield from common.batches(((int(bucket[a]), half, own[row[a:b]].tobytes(), anchor[a:b].astype("<u4").tobytes()) for a, b in zip(begins, ends, strict=True)), _CELLS)

    def compare(group: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(a, "<u4").astype(np.uint64) + np.uint64(h << 32) for a, h in zip(group["anchors"].to_pylist(), group["half"].to_pylist(), strict=True)])
        own = np.concatenate([np.frombuffer(x, np.uint64) for x in group["prints"].to_pylist()])
        runs, run, sizes = np.unique(keys, return_inverse=True, return_counts=True)
        short = (sizes <= RUN)[run]
        a, b = links(keys[short], own[short])
        rows = [(int(x), int(y), None, None, None, None) for x, y in zip(a.view(np.int64), b.view(np.int64), strict=True)]
        for k in np.flatnonzero(sizes > RUN).tolist():
            there, n = own[run == k], -(-int(sizes[k]) // RUN)
            rows += [(None, None, int(runs[k]), block, n, there[block::n].tobytes()) for block in range(n)]
        return pa.Table.from_batches(list(common.batches(rows, _FOUND)), _FOUND)

    def meet(group: pa.Table) -> pa.Table:
        one = {k: np.frombuffer(x, np.uint64) for k, x in zip(group["block"].to_pylist(), group["prints"].to_pylist(), strict=True)}
        a, b = links_across(one[min(one)], one[max(one)])
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=_LINKS)

    cells = prints.select("fp").mapInArrow(spread, "bucket long, half int, prints binary, anchors binary")
    found = common.written(cells.groupBy("bucket").applyInArrow(compare, _FOUND_DDL))
    # a block meets every block of its run: x before it as (x, own), itself and y after it as (own, y)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("p"), F.greatest(x, "block").alias("q")))
    long_runs = found.filter("anchor IS NOT NULL").repartition("anchor", "block").select("anchor", "block", "prints", F.explode(pairs).alias("pair"))
    across = long_runs.groupBy("anchor", "pair").applyInArrow(meet, "a long, b long")
    return found.filter("a IS NOT NULL").select("a", "b").unionByName(across)


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose fingerprints link: (doc_id, key, fp, component_id, kept), one row per input row.

    Fingerprints link at three or fewer differing bits; ``component_id`` is the
    smallest id reachable by links, the row's own included.  ``kept`` marks the
    one document that stands for a group: the first by id, rows without an id
    last, and then by ``key``, 128 bits of the text; every other row is a
    near-duplicate.  Equal fingerprints are one node, so copies are never paired
    with each other.

    A null or empty text has fingerprint 0 and links like any other.  Rows with
    a null id take part; a group of such rows alone has a null component_id and
    still keeps one.  Rows that repeat id and text are one document, kept
    together.  Other columns of ``docs`` are not read.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    with lineage.scope():
        rows = lineage.Table(fingerprints(docs, id_col, text_col)).keep()
        nodes = common.written(rows.groupBy("fp").agg(F.min(row).alias("least")))
        labels = connected_components(near_links(nodes))
        named = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
        named = lineage.Table(named).keep()
    groups = named.groupBy("component").agg(F.min("least").alias("first")).select(anew(named, "component").alias("c"), "first")
    found = rows.join(named.join(groups, F.col("component") == F.col("c")).select("fp", "first"), "fp")
    return found.select("doc_id", "key", "fp", F.col("first.doc_id").alias("component_id"), row.eqNullSafe(F.col("first")).alias("kept"))
