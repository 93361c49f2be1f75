"""The structure of JSON values: types, presence and nulls of every path."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid import lineage
from loamgrid.functions.lattice import BIT, resolve, type_label


@dataclass
class Node:
    """What is known about a path: how often each type was seen, how often it was there, and of how many."""

    name: str
    path: str
    bits: int = 0
    present: int = 0
    nulls: int = 0
    total: int = 0
    children: dict[str, Node] = field(default_factory=dict)
    item: Node | None = None

    @property
    def type(self) -> str:
        return resolve(self.bits)

    @property
    def missing(self) -> int:
        return self.nulls + self.total - self.present

    @property
    def nullable(self) -> bool:
        return self.missing > 0

    @property
    def label(self) -> str:
        text = type_label(self.bits)
        if self.item is not None and self.item.total:
            return "|".join(f"list[{self.item.label}]" if t == "list" else t for t in text.split("|"))
        return text


def _kind(value):
    """Type bit of a variant from the name of its schema."""
    name = F.schema_of_variant(value)
    whole = name.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$")
    return (
        F.when(F.is_variant_null(value) | (name == "VOID"), BIT["null"]).when(name == "BOOLEAN", BIT["bool"]).when(whole, BIT["int"]).when(name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), BIT["float"])
        .when(name.startswith("ARRAY"), BIT["list"]).when(name.startswith("OBJECT"), BIT["object"]).when(name == "DATE", BIT["date"]).when(name.startswith("TIMESTAMP"), BIT["datetime"]).otherwise(BIT["str"])
    )


#: Levels after which the next level and the paths so far are written out: plans stay short however deep the JSON is.
LEVELS = 8


def structure(frame: DataFrame, json_col: str, most_depth: int | None = None) -> DataFrame:
    """(path, depth, bits, present, nulls, objects) of every path in a column of JSON text.

    A path is ``$`` followed by ``.key`` and ``[]`` steps.  One level at a time
    is exploded from the variants of the level above until none has children, or
    down to ``most_depth`` where it is given; a level is one aggregate whose partial
    sums precede the shuffle.  Texts that are not JSON count as missing documents.
    """
    level = frame.select(F.lit("$").alias("path"), F.try_parse_json(F.col(json_col)).alias("v")).filter("v IS NOT NULL")
    out = None
    for depth in itertools.count():
        kind = level.select("path", "v", _kind(F.col("v")).alias("bit"))
        found = kind.groupBy("path").agg(F.bit_or("bit").cast("long").alias("bits"), F.count("*").alias("present"), F.count_if(F.col("bit") == BIT["null"]).alias("nulls"), F.count_if(F.col("bit") == BIT["object"]).alias("objects")).withColumn("depth", F.lit(depth))
        out = found if out is None else out.unionByName(found)
        inner = kind.filter(F.col("bit").isin(BIT["list"], BIT["object"]))
        if depth == most_depth or inner.limit(1).count() == 0:
            break
        each = inner.select("path", "v").lateralJoin(frame.sparkSession.tvf.variant_explode(F.col("v").outer()))
        level = each.select(F.concat("path", F.coalesce(F.concat(F.lit("."), "key"), F.lit("[]"))).alias("path"), F.col("value").alias("v"))
        if depth % LEVELS == LEVELS - 1:
            level, out = lineage.fixed(level), lineage.fixed(out)
    return out.select("path", "depth", "bits", "present", "nulls", "objects")


def tree(frame: DataFrame, json_col: str) -> Node:
    """The structure as nodes; a child's total is the number of objects above it, an item's the number of elements."""
    rows = {r["path"]: r for r in structure(frame, json_col).collect()}  # one row for each path
    root = Node("$", "$")
    nodes = {"$": root}
    for path in sorted(rows, key=lambda p: (rows[p]["depth"], p)):
        row = rows[path]
        node = nodes.get(path)
        if node is None:
            above = path[:-2] if path.endswith("[]") else path.rpartition(".")[0]
            node = Node("[]" if path.endswith("[]") else path.rpartition(".")[2], path)
            parent = nodes[above]
            if path.endswith("[]"):
                parent.item = node
            else:
                parent.children[node.name] = node
            nodes[path] = node
        node.bits, node.present, node.nulls = row["bits"], row["present"], row["nulls"]
        node.total = node.present
    for path, node in nodes.items():
        for child in node.children.values():
            child.total = rows[path]["objects"]
    return root


def render_tree(root: Node, depth: int | None = None, show_counts: bool = True) -> str:
    """The tree as indented text."""
    lines = []

    def walk(node: Node, level: int) -> None:
        counts = f"  {node.present}/{node.total}" + (" nullable" if node.nullable else "") if show_counts else ""
        lines.append("  " * level + f"{node.name}: {node.label}{counts}")
        if depth is not None and level >= depth:
            return
        for child in node.children.values():
            walk(child, level + 1)
        if node.item is not None and (node.item.children or node.item.item):
            for child in node.item.children.values():
                walk(child, level + 1)

    walk(root, 0)
    return "\n".join(lines)
