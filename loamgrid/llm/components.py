"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid import lineage


def anew(frame: DataFrame, column: str) -> Column:
    """The same value (a long or a string), but not the column that an exchange was made by: a join may split its rows."""
    if frame.schema[column].dataType.simpleString() == "string":
        return F.concat(F.col(column), F.lit(""))
    return F.bitwise_not(F.bitwise_not(column))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, component being its smallest reachable node.

    Alternates the large-star and small-star steps, which turn every component
    into a star around its smallest node in a number of rounds that grows with
    the logarithm of its diameter.  Each step joins edges with the minimum of a
    node's neighbours (numbers or strings), so a node of any degree is aggregated before it is
    shuffled and its edges may be split by a skewed join.  Rows that hold a null
    or join a node to itself make no edge; an empty input gives an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    held = lineage.Table(pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct())
    before = None
    for _ in range(most_rounds):
        e = held.frame
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(anew(e, "u").alias("w"), "m")
        large = both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(anew(e, "u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w"))
        star = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        new = lineage.Table(star)
        held.drop()
        held = new
        now = held.frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    stars = held.frame
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
