"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgrid import lineage

from . import common

#: Documents that a bucket of a leaf's order is meant to hold, and buckets whose sums are run through together.
BUCKET_DOCS = 1024
RUN_BUCKETS = 1024
#: Parts among which a leaf's documents are dealt to meet its budget.
SALTS = 32
#: Names the value of a null level.
NONE = "(none)"


def weight_of(level: Column, weights: Mapping[str, int], default: int = 1) -> Column:
    """An integer weight for each value of a level."""
    if any(w < 1 for w in [*weights.values(), default]):
        raise ValueError("weights are whole numbers of at least one")
    if not weights:
        return F.lit(default).cast("long")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, level), F.lit(default)).cast("long")


def share(nodes: DataFrame, parents: list[str], node: str, weight: Column, budget: str) -> DataFrame:
    """Deal each parent's ``budget`` to its nodes by weight, none above its ``capacity``.

    ``nodes`` has a row for each node with its capacity and its parent's budget.
    What a node cannot take goes to its siblings by their weights.  Sorted by
    capacity over weight the full nodes come first: a node is full if, dealt by
    weight among it and those after it, what the full ones before leave would
    exceed its capacity.
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("capacity") / F.col("weight"), node)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.col("capacity") * F.col("w_after") <= F.col("weight") * (F.col(budget) - F.col("c_before"))
    rows = nodes.withColumn("weight", weight)
    rows = rows.withColumn("c_before", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("w_after", F.sum("weight").over(after)).withColumn("full", full)
    rest = F.col(budget) - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(by), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by)
    rows = rows.withColumn("rest", rest).withColumn("open_weight", open_weight)
    dealt = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("weight * rest div open_weight"))
    return rows.withColumn("dealt", dealt).drop("weight", "c_before", "w_after", "full", "rest", "open_weight")


def leaf_budgets(leaves: DataFrame, total: Column, weights: Mapping[str, Mapping[str, int]], most_epochs: int) -> DataFrame:
    """(domain, lang, source, n_docs, tokens, budget) from the leaves' tokens."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * most_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    supply = leaves.agg(F.sum("tokens").alias("supply")).select(total.alias("total"))
    top = share(domains.crossJoin(F.broadcast(supply)), [], "domain", weight_of(F.col("domain"), weights.get("domain", {})), "total")  # one row of totals
    top = top.select("domain", F.col("dealt").alias("d_budget"))
    mid = share(langs.join(top, "domain"), ["domain"], "lang", weight_of(F.col("lang"), weights.get("lang", {})), "d_budget")
    mid = mid.select("domain", "lang", F.col("dealt").alias("l_budget"))
    low = share(leaves.join(mid, ["domain", "lang"]), ["domain", "lang"], "source", weight_of(F.col("source"), weights.get("source", {})), "l_budget")
    return low.select("domain", "lang", "source", "n_docs", "tokens", F.col("dealt").alias("budget"))


def mix_sources(
    docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], percent: int = 100, most_epochs: int = 4, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: tuple[str, ...] = (),
) -> DataFrame:
    """Choose documents so that the sources' tokens meet target weights.

    The tree is domain, language, source.  ``percent`` of all tokens (words split
    at space and ASCII 9 to 13) is the root's budget; every node deals its budget
    to its children by ``weights[level][name]`` (1 where not given), and a child
    that cannot use its share, at ``most_epochs`` times its tokens, leaves it to
    its siblings.  Budgets are dealt from the root under the capacity of whole
    subtrees, so only what a node's children cannot take together ever leaves it:
    siblings come before ancestors.  Divisions round down.

    A leaf with budget b and t tokens takes all documents b div t times and, of
    the next epoch, the longest prefix within what remains.  Epoch e's order is by
    md5(seed:e:id).  Returns (doc_id, domain, lang, source, n_tokens, copies) and
    the columns named in ``carry``, one row per input row; copies is 0 for
    documents left out.  The texts are read once, to count their tokens.

    Null domains, languages and sources are named "(none)".  A null or empty text
    has no tokens: it costs nothing and is in each prefix that reaches it; a leaf
    without tokens has copies 0.  A null id is ordered as the empty string.  Rows
    that repeat an id are ordered by their tokens.  Other columns of ``docs`` are
    not read.
    """
    carried = {f"c{k}": c for k, c in enumerate(carry)}
    with lineage.scope():
        rows = lineage.Table(docs.select(
            F.col(id_col).alias("doc_id"), F.coalesce(domain, F.lit(NONE)).alias("domain"), F.coalesce(F.col(lang_col), F.lit(NONE)).alias("lang"), F.coalesce(F.col(source_col), F.lit(NONE)).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"), *(F.col(c).alias(k) for k, c in carried.items()),
        )).keep()
        leaf = ["domain", "lang", "source"]
        leaves = common.written(rows.groupBy(*leaf).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens")))
        budgets = lineage.Table(leaf_budgets(leaves, F.expr(f"supply * {int(percent)} div 100"), weights, most_epochs)).keep()
    epochs = F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 0 END")
    left = F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE -1 END")
    parts = F.ceil(F.col("n_docs") / BUCKET_DOCS)
    plan = budgets.select(*leaf, epochs.alias("epochs"), left.alias("left"), parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS)).cast("int")).join(plan, [*leaf, "salt"]).withColumn("key", key)
    # the leading digits of the order's key deal a leaf's documents into ranges of it
    dealt = dealt.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 10), 16, 10).cast("long") * F.col("parts") / (1 << 40)))
    base = bucket_bases(dealt.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("in_bucket")), leaf)
    inside = Window.partitionBy(*leaf, "bucket").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = dealt.withColumn("run", F.sum("n_tokens").over(inside)).join(base, [*leaf, "bucket"])
    taken = F.when(F.col("base") + F.col("run") <= F.col("left"), 1).otherwise(0)
    return run.select("doc_id", *leaf, "n_tokens", (F.col("epochs") + taken).cast("long").alias("copies"), *(F.col(k).alias(c) for k, c in carried.items()))


def bucket_bases(sums: DataFrame, leaf: list[str]) -> DataFrame:
    """(leaf, bucket, base): the tokens of a leaf's earlier buckets, from (leaf, bucket, in_bucket).

    Summed in two levels: a task runs through RUN_BUCKETS buckets, then through
    the sums of so many, not through all buckets of a large leaf.
    """
    sums = sums.withColumn("group", F.floor(F.col("bucket") / RUN_BUCKETS))
    before = lambda *by: Window.partitionBy(*leaf, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy(*leaf, "group").agg(F.sum("in_bucket").alias("in_group"))
    groups = groups.select(*leaf, "group", F.coalesce(F.sum("in_group").over(before("group")), F.lit(0)).alias("of_groups"))
    inside = sums.select(*leaf, "bucket", "group", F.coalesce(F.sum("in_bucket").over(before("group", "bucket")), F.lit(0)).alias("of_buckets"))
    return inside.join(groups, [*leaf, "group"]).select(*leaf, "bucket", (F.col("of_groups") + F.col("of_buckets")).alias("base"))
