"""Embedding near-dedup by collision-counting projections.

Vectors are scaled to length one and projected on many orthonormal directions.
A pair collides in a projection if the second falls into the window centred on
the first's value.  Two unit vectors of cosine c are at distance
d = sqrt(2 - 2c); along m orthonormal directions their differences' squares sum
up to d^2 at most, so fewer than d^2 / w^2 directions can differ by more than w.
With the window w = d / sqrt(q m) less than q m of m collisions can be missing:
a pair with at least m - q m collisions is verified, and no such pair is missed.

That count is taken among the vectors of a cell.  A label of up to WHOLE vectors
is one cell.  A larger one is dealt into cells by several tables: each table cuts
``depth`` sorted projections of its own into ranges, and a cell is one range of
each.  Pairs at the least cosine are calibrated to share a cell in some table
with probability RECALL, closer pairs with more.  A pair that shares several is
counted in the first.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid import lineage

from . import common
from .components import anew, connected_components

#: Vectors in a block; blocks of one cell are compared two by two.
BLOCK = 1024
#: Vectors of a label that are one cell.
WHOLE = 16 * BLOCK
#: Probability that a pair at the least cosine meets in some table; the rest is the method's only loss.
RECALL = 1 - 1e-6
#: A range of a sorted projection is so many times as wide as a pair at the least cosine differs there, in the root mean square.
RANGE = 5.0
#: Share of collisions that a pair may miss.
MISSING = 0.25
#: So few pairs are verified at once, without a count.
FEW_PAIRS = 1024
#: Entries (a vector in a cell) that a task meets together, in cells of any size.
TASK_ENTRIES = 8 * BLOCK
#: Queries counted together.
QUERIES = 128

_FOUND = pa.schema([("node", pa.string()), ("n_links", pa.int64()), ("least", pa.string())])
_CELLS = pa.schema([("node", pa.string()), ("v", pa.list_(pa.float64())), ("copies", pa.int64()), ("kind", pa.int64()), ("tables", pa.list_(pa.int32()))])


def directions(width: int, most: int = 32, seed: int = 17) -> np.ndarray:
    """Orthonormal directions as columns: up to ``most`` of a random rotation."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q[:, : min(width, most)]


class Projections:
    """One block's values along every direction, each sorted, and the windows of another block's queries in them."""

    def __init__(self, values: np.ndarray, queries: np.ndarray, window: float):
        n, m = values.shape
        kind = np.uint16 if n < 1 << 16 else np.uint32  # unsigned: see collisions()
        self.rank, self.low, self.wide = np.empty((m, n), kind), np.empty((m, len(queries)), kind), np.empty((m, len(queries)), kind)
        for k in range(m):
            order = np.argsort(values[:, k], kind="stable")
            self.rank[k, order] = np.arange(n)
            line = values[order, k]
            low = np.searchsorted(line, queries[:, k] - window)
            self.low[k], self.wide[k] = low, np.searchsorted(line, queries[:, k] + window, side="right") - low

    def collisions(self, rows: np.ndarray, there: np.ndarray) -> np.ndarray:
        """In how many projections each of ``there`` has its rank in the window centred on each query of ``rows``."""
        count = np.zeros((len(rows), len(there)), np.uint8)
        for rank, low, wide in zip(self.rank[:, there], self.low[:, rows], self.wide[:, rows], strict=True):
            count += (rank[None, :] - low[:, None] < wide[:, None]).view(np.uint8)  # below the window the difference wraps around
        return count


def pairs_within(a: np.ndarray, b: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit rows (i of a, j of b; i < j in one block) with cosine >= ``least``."""
    if len(a) * len(b) <= FEW_PAIRS:
        i, j = np.indices((len(a), len(b))).reshape(2, -1)
        i, j = (i[i < j], j[i < j]) if same else (i, j)
        near = np.einsum("ij,ij->i", a[i], b[j]) >= least
        yield i[near], j[near]
        return
    axes = directions(a.shape[1])
    m, reach = axes.shape[1], math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    missing = max(1, math.ceil(MISSING * m))
    pa_, pb_ = a @ axes, b @ axes
    lines = Projections(pb_, pa_, reach / math.sqrt(missing))
    by_first = np.argsort(pb_[:, 0], kind="stable")
    sorted_first = pb_[by_first, 0]
    mine = np.argsort(pa_[:, 0], kind="stable")
    for start in range(0, len(mine), QUERIES):
        rows = mine[start : start + QUERIES]
        # no pair is further apart along any direction than it is
        low = np.searchsorted(sorted_first, pa_[rows[0], 0] - reach)
        high = np.searchsorted(sorted_first, pa_[rows[-1], 0] + reach, side="right")
        there = by_first[low:high]
        i, j = np.nonzero(lines.collisions(rows, there) > m - missing - 1)
        i, j = rows[i], there[j]
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            near = np.einsum("ij,ij->i", a[x], b[y]) >= least
            yield x[near], y[near]


def depth_for(n: int) -> int:
    """How many projections a table cuts for a label of ``n`` vectors: about half of all pairs share a range."""
    return 0 if n <= WHOLE else math.ceil(math.log2(n / BLOCK))


def tables_for(depth: int) -> int:
    """How many tables it takes for RECALL.

    Along any direction a pair's difference is close to normal; a pair that
    differs by s shares a range of width r with probability 1 - s / r.
    """
    if not depth:
        return 1
    together = (1 - math.sqrt(2 / math.pi) / RANGE) ** depth
    return math.ceil(math.log(1 - RECALL) / math.log1p(-together))


@functools.lru_cache(maxsize=64)
def _table_axes(width: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every table its orthonormal directions, side by side, and where its ranges begin."""
    rng, depth = np.random.default_rng([23, width, depth]), min(depth, width)
    n_tables = tables_for(depth)
    axes = np.concatenate([np.linalg.qr(rng.standard_normal((width, depth)))[0] for _ in range(n_tables)], 1)
    return axes, rng.random(n_tables * depth)


def cells_of(unit: np.ndarray, n: int, least: float) -> np.ndarray:
    """The cell of each unit vector of a label of ``n`` vectors in every table, as 32 bits."""
    depth = depth_for(n)
    if not depth:
        return np.zeros((len(unit), 1), np.int32)
    width = unit.shape[1]
    axes, begin = _table_axes(width, depth)
    wide = RANGE * math.sqrt((2 - 2 * least) / width)
    ranges = np.floor(unit @ axes / wide + begin).astype(np.int64).reshape(len(unit), -1, min(depth, width))
    cell = np.zeros(ranges.shape[:2], np.uint64)
    for k in range(ranges.shape[2]):
        cell = common.mix(cell * np.uint64(0x9E3779B97F4A7C15) + ranges[:, :, k].astype(np.uint64))
    return (cell >> np.uint64(32)).astype(np.uint32).view(np.int32)


class Group(NamedTuple):
    """Unit vectors that meet, how many copies each stands for, and their cells in the tables before this one."""

    unit: np.ndarray
    copies: np.ndarray
    earlier: np.ndarray


def compare(left: Group, right: Group | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, links, smallest linked index) of the linked vectors of two blocks, numbered one after the other, or of one with itself."""
    a, b = left, left if right is None else right
    shift = 0 if right is None else len(a.unit)
    copies = a.copies if right is None else np.concatenate([a.copies, b.copies])
    n = len(copies)
    n_links, one, other = np.zeros(n), np.empty(0, np.int64), np.empty(0, np.int64)
    for i, j in pairs_within(a.unit, b.unit, least, right is None):
        new = ~(a.earlier[i] == b.earlier[j]).any(1)
        i, j = i[new], j[new] + shift
        n_links += np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        one, other = np.append(one, i), np.append(other, j)
        if len(one) > 1 << 20:
            label = common.local_components(n, one, other)
            one = np.flatnonzero(label != np.arange(n))
            other = label[one]
    label = common.local_components(n, one, other)
    linked = np.flatnonzero(n_links)
    return linked, n_links[linked].astype(np.int64), label[linked]


def _unit(values: np.ndarray, n: int) -> np.ndarray:
    """``n`` vectors, one after the other, as unit rows in double precision."""
    x = values.reshape(n, -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and where each row's begin and end."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, v, label, node): vectors that may link have a node, the same for equal vectors of a label."""
    narrow = vectors.schema[vector_col].dataType.simpleString() in ("array<float>", "array<double>")
    value = F.col(vector_col) if narrow else F.col(vector_col).cast("array<double>")  # floats travel as they are
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), value.alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & (F.array_max(F.transform("v", F.abs)) > 0)
    key = F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), F.col("label"), F.col("v"))), 16, "0") for seed in (1, 2)))
    return rows.withColumn("node", F.when(usable, key))


def _cells(nodes: DataFrame, least: float) -> DataFrame:
    """(node, v, copies, kind, tables) of nodes with their label's size n: the cells in every table; ``kind`` tells labels and widths apart."""
    vector = nodes.schema["v"].dataType
    schema = _CELLS.set(1, pa.field("v", pa.list_(pa.float32() if vector.simpleString() == "array<float>" else pa.float64())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5)], 1)
            for width, n in np.unique(shape, axis=0).tolist():
                own = batch.take(pa.array(np.flatnonzero((shape == [width, n]).all(1))))
                cells = cells_of(_unit(own.column(1).flatten().to_numpy(zero_copy_only=False), own.num_rows), n, least)
                offsets = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1])
                columns = [c.cast(f.type) for c, f in zip(own.columns[:4], schema, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))], schema=schema)

    kind = F.xxhash64("label", "width").alias("kind")
    return nodes.select("node", "v", "copies", kind, "width", "n").mapInArrow(work, f"node string, v {vector.simpleString()}, copies long, kind long, tables array<int>")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """Link vectors of one label whose cosine (double precision) is at least ``least``.

    Returns (vec_id, n_links, component_id, kept), one row per input row:
    component_id is the smallest id reachable by links, the row's own included,
    and kept tells whether it is the row's own.

    A null, empty or zero vector, one with a null or non-finite component and
    one whose label is null link with nothing, and so do vectors of different
    length.  A row with a null id links with nothing and is kept, with a null
    component_id.  Rows that repeat an id are separate vectors which link with
    each other like others; each has its own links.  Other columns of
    ``vectors`` are not read.

    Equal vectors of a label are one node with a number of copies.  A task meets
    two blocks of a cell and returns counts and a forest, never pairs; a cell of
    any size is split into blocks, so a dense cluster costs many tasks, not a
    large one.
    """
    rows = _usable(vectors, id_col, vector_col, label_col)
    with lineage.scope():
        good = rows.filter("node IS NOT NULL").withColumn("width", F.size("v"))
        nodes = good.groupBy("label", "width", "node").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
        nodes = lineage.Table(nodes).keep()
        salted = nodes.groupBy("label", "width").agg(F.count("*").alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        sized = nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64)).cast("int")).join(salted, ["label", "width", "salt"])
        found = common.written(_compared(common.written(_cells(sized, least)), least))
        n_links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
        labels = connected_components(found, "node", "least").withColumnRenamed("node", "l_node")
        named = nodes.select("node", "copies", "least_id").join(n_links, "node", "left")
        named = named.join(labels, F.col("node") == F.col("l_node"), "left").select("node", F.coalesce("component", "node").alias("component"), "least_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        named = lineage.Table(named).keep()
    groups = named.groupBy("component").agg(F.min("least_id").alias("component_id")).select(anew(named, "component").alias("c"), "component_id")
    result = named.join(groups, F.col("component") == F.col("c")).select(anew(named, "node").alias("r_node"), F.col("n_links").alias("r_links"), "component_id")
    out = rows.select("vec_id", "node").join(result, F.col("node") == F.col("r_node"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("r_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _compared(cells: DataFrame, least: float) -> DataFrame:
    """(node, n_links, least) of every pair of blocks of every cell."""
    entries = cells.select("node", "kind", F.posexplode("tables").alias("table", "cell"))
    sizes = common.written(entries.groupBy("kind", "table", "cell").count().filter("count > 1").withColumn("k", F.ceil(F.col("count") / BLOCK).cast("int")))
    n_tasks = max(32, (sizes.agg(F.sum(F.col("count") * F.col("k"))).first()[0] or 0) // TASK_ENTRIES)
    # cells of more than a block, by node: in which tables, and of how many blocks
    crowded = entries.join(sizes.filter("k > 1"), ["kind", "table", "cell"]).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("table", "k"))).alias("crowded"))
    dealt = cells.join(crowded, "node", "left").select("node", "kind", "v", "copies", "tables", "crowded", F.posexplode("tables").alias("table", "cell"))
    k = F.coalesce(F.try_element_at("crowded", F.col("table")), F.lit(1))
    dealt = dealt.withColumn("k", k).withColumn("block", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("k")).cast("int"))
    # block b takes part in the pairs (x, b) for x <= b and (b, y) for y > b
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: F.struct(F.least(x, "block").alias("p"), F.greatest(x, "block").alias("q")))
    earlier = F.slice("tables", F.lit(1), F.col("table"))
    dealt = dealt.select("kind", "table", "cell", "node", "v", "copies", "block", earlier.alias("earlier"), F.explode(pairs).alias("pair"))
    key = F.xxhash64("kind", "table", "cell", "pair")
    dealt = dealt.select(F.pmod(key, F.lit(n_tasks)).alias("task"), key.alias("key"), (F.col("block") != F.col("pair.p")).alias("second"), (F.col("pair.p") == F.col("pair.q")).alias("alone"), "node", "v", "copies", "earlier")

    def meet(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["second"].to_numpy(), group["key"].to_numpy()))
        group = group.take(pa.array(order)).combine_chunks()
        key, second, alone, copies = (group[c].to_numpy() for c in ("key", "second", "alone", "copies"))
        v, v_at = _lists(group["v"].chunk(0))
        seen, seen_at = _lists(group["earlier"].chunk(0))
        own = lambda a, b: Group(_unit(v[v_at[a] : v_at[b]], b - a), copies[a:b], seen[seen_at[a] : seen_at[b]].reshape(b - a, -1))
        edges, out = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])), []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            cut = b if alone[a] else a + int(np.searchsorted(second[a:b], True))
            if cut > a and (cut < b or alone[a] and b - a > 1):
                at, n_links, smallest = compare(own(a, cut), None if alone[a] else own(cut, b), least)
                if len(at):
                    out.append((a + at, n_links, a + smallest))
        if not out:
            return _FOUND.empty_table()
        at, n_links, smallest = map(np.concatenate, zip(*out, strict=True))
        node = group["node"].chunk(0)
        return pa.Table.from_arrays([node.take(pa.array(at)), pa.array(n_links), node.take(pa.array(smallest))], schema=_FOUND)

    return dealt.groupBy("task").applyInArrow(meet, "node string, n_links long, least string")
