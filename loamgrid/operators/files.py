"""Duplicates, partitions and buckets of documents or files."""

from __future__ import annotations

import heapq
import itertools
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from loamgrid import lineage
from loamgrid.errors import DataError


def duplicate_groups(docs: DataFrame, id_col: str, content: Column) -> DataFrame:
    """(sha256, size, copies, wasted, keep) of contents that occur more than once; ``keep`` is the smallest id."""
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(content.cast("binary"), 256).alias("sha256"), F.octet_length(content).cast("long").alias("size")).filter("sha256 IS NOT NULL")
    groups = rows.groupBy("sha256", "size").agg(F.count("*").alias("copies"), F.min("id").alias("keep")).filter("copies > 1")
    return groups.select("sha256", "size", "copies", (F.col("size") * (F.col("copies") - 1)).alias("wasted"), "keep")


def duplicate_victims(docs: DataFrame, id_col: str, content: Column) -> DataFrame:
    """(id, sha256, keep) of every copy but the first.

    Groups are aggregated and shuffled anew for the join, whose sides are then
    both plain exchanges: the rows of a large group may be split among tasks.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(content.cast("binary"), 256).alias("sha256")).filter("sha256 IS NOT NULL")
    groups = rows.groupBy("sha256").agg(F.count("*").alias("n"), F.min("id").alias("keep")).filter("n > 1").select(F.concat("sha256", F.lit("")).alias("group"), "keep")
    return rows.join(groups, F.col("sha256") == F.col("group")).filter("id <> keep").select("id", "sha256", "keep")


def total_size(docs: DataFrame, content: Column) -> DataFrame:
    return docs.agg(F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def ranked(docs: DataFrame, order: list[Column], name: str = "row", ranges: int = 0) -> DataFrame:
    """Adds the zero-based place in a total order without one task for all rows.

    Rows are dealt into ranges of the order; every range is numbered by itself
    and starts after the counts of those before it.  The ranges come from a sample
    that another run of the plan would draw anew, so the dealt rows are written
    once and read for both the counts and the numbers.
    """
    spark = docs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lineage.fixed(docs.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(*order)
    numbered = dealt.withColumn("__k", F.row_number().over(inside) - 1).join(F.broadcast(before), "__range")  # one row for each range
    return numbered.withColumn(name, F.col("__k") + F.col("__before")).drop("__range", "__k", "__before")


def split_even(docs: DataFrame, parts: int, order: list[Column]) -> DataFrame:
    """Adds ``part`` (from 1): consecutive parts of equal count, the first ones one larger."""
    total = docs.count()
    base, more = divmod(total, parts)
    row = F.col("__row")
    large = more * (base + 1)
    part = F.when(row < large, F.floor(row / (base + 1))).otherwise(more + F.floor((row - large) / max(1, base))) + 1
    return ranked(docs, order, "__row").withColumn("part", part.cast("int")).drop("__row")


def split_chunks(docs: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """Adds ``chunk`` (from 1) of ``size`` rows each."""
    if size < 1:
        raise DataError("A chunk holds at least one row.")
    return ranked(docs, order, "__row").withColumn("chunk", (F.floor(F.col("__row") / size) + 1).cast("long")).drop("__row")


def balanced(sizes: Iterable[tuple[object, int]], parts: int) -> dict:
    """The part (from 1) of each item: largest first, each to the part that is smallest so far."""
    return {key: part for key, _, part in _balanced(sorted(sizes, key=lambda item: -item[1]), parts)}


def _balanced(falling: Iterable[tuple[object, int]], parts: int) -> Iterator[tuple[object, int, int]]:
    heap = [(0, part) for part in range(1, parts + 1)]
    for key, size in falling:
        held, part = heap[0]
        heapq.heapreplace(heap, (held + size, part))
        yield key, size, part


def filled(sizes: Iterable[tuple[object, int]], capacity: int, threshold: float = 0.05) -> dict:
    """The part of each item when parts are filled to ``capacity``.

    Largest first, each to the smallest part; one that exceeds what is left by
    more than ``threshold`` of the capacity opens a part, and so does an item
    larger than any part unless the smallest is empty.
    """
    return {key: part for key, _, part in _filled(sorted(sizes, key=lambda item: -item[1]), capacity, threshold)}


def _filled(falling: Iterable[tuple[object, int]], capacity: int, threshold: float = 0.05) -> Iterator[tuple[object, int, int]]:
    heap = [(0, 1)]
    for key, size in falling:
        held, part = heap[0]
        over = size > capacity - held + threshold * capacity if size <= capacity else held > 0
        if over:
            part = len(heap) + 1
            heapq.heappush(heap, (size, part))
        else:
            heapq.heapreplace(heap, (held + size, part))
        yield key, size, part


#: Assignments that the driver holds before they are written.
GREEDY_ROWS = 100_000


def partition_by_size(docs: DataFrame, id_col: str, size: Column, parts: int = 0, capacity: int = 0) -> DataFrame:
    """(id, size, part) by ``balanced`` over ``parts`` or ``filled`` to ``capacity``; a null size is 0.

    Greedy by nature: Spark sorts ids and sizes, and the driver takes them one
    range of the order at a time and writes assignments out as they come.  It
    holds a range, GREEDY_ROWS assignments and the sizes of the parts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    schema = StructType([*rows.schema.fields, StructField("part", IntegerType())])
    falling = ((r["id"], r["size"]) for r in rows.orderBy(F.desc("size"), "id").toLocalIterator())
    placed = _balanced(falling, parts) if parts else _filled(falling, capacity)
    path = f"{lineage.shared_folder(spark)}/loamgrid-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    for batch in itertools.batched(placed, GREEDY_ROWS):
        spark.createDataFrame(list(batch), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def bucket_counts(docs: DataFrame, key: Column) -> DataFrame:
    """(bucket, n) of a derived key."""
    return docs.groupBy(F.coalesce(key, F.lit("")).alias("bucket")).agg(F.count("*").alias("n"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^./]+(\.[^./]+)$", 1))


def first_letter(name: Column) -> Column:
    first = F.upper(F.substring(name, 1, 1))
    return F.when(F.regexp_like(first, F.lit(r"(?U)^\p{L}$")), first).when(first.rlike("^[0-9]$"), "0-9").otherwise("#")


def text_files(spark: SparkSession, path: str, glob: str | None = None, most_bytes: int | None = None, name_regex: str | None = None, exclude: Iterable[str] = ()) -> DataFrame:
    """(path, length, text) of the text files under a folder.

    Files with a zero byte, or with 30 % or more control bytes in their first
    8000, count as binary and are left out; filters on names and sizes run before
    a file is opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    if most_bytes is not None:
        files = files.filter(F.col("length") <= most_bytes)
    name = F.substring_index("path", "/", -1)
    if name_regex:
        files = files.filter(name.rlike(name_regex))
    for pattern in exclude:
        files = files.filter(~name.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in pattern) + "$"))
    head = F.decode(F.substring("content", 1, 8000), "ISO-8859-1")
    control = F.char_length(F.regexp_replace(head, r"[^\x01-\x08\x0E-\x1A\x1C-\x1F\x7F]", ""))
    files = files.filter((F.instr(head, "\0") == 0) & (control <= 0.3 * F.char_length(head)))
    return files.select("path", "length", F.decode("content", "UTF-8").alias("text"))


def entry_matches(names: DataFrame, name_col: str, pattern: str) -> DataFrame:
    return names.filter(F.col(name_col).rlike(pattern))


def name_collisions(source: DataFrame, target: DataFrame, policy: str = "no") -> DataFrame:
    """(name, size, action) when ``source`` (name, size) is merged into ``target``.

    Policies: yes (overwrite), no (skip), same-size (overwrite if sizes are equal),
    keep-both (a new name).
    """
    if policy not in ("yes", "no", "same-size", "keep-both"):
        raise DataError(f"Unknown policy {policy!r}.")
    there = target.select(F.col("name").alias("t_name"), F.col("size").alias("t_size")).dropDuplicates(["t_name"])
    met = {"yes": F.lit("overwrite"), "no": F.lit("skip"), "keep-both": F.lit("rename"), "same-size": F.when(F.col("size") == F.col("t_size"), "overwrite").otherwise("skip")}[policy]
    joined = source.join(there, F.col("name") == F.col("t_name"), "left")
    return joined.select("name", "size", F.when(F.col("t_name").isNull(), "move").otherwise(met).alias("action"))


def batch_rename(names: DataFrame, name_col: str, find: str, put: str) -> DataFrame:
    """(old, new, action): renames by regular expression; a new name that exists or comes up twice is skipped."""
    new = F.regexp_replace(F.col(name_col), find, put)
    rows = names.select(F.col(name_col).alias("old"), new.alias("new"))
    counts = rows.groupBy("new").agg(F.count("*").alias("n")).withColumnRenamed("new", "c_new")
    action = F.when(F.col("old") == F.col("new"), "same").when((F.col("n") > 1) | (F.col("new") == ""), "skip").otherwise("rename")
    return rows.join(counts, F.col("new") == F.col("c_new")).select("old", "new", action.alias("action"))


def random_texts(spark: SparkSession, files: int, sentences: int, seed: int = 1) -> DataFrame:
    """(file, text): test texts of random sentences, the same for a seed."""
    words = F.array(*map(F.lit, ("river", "stone", "quiet", "letter", "garden", "winter", "signal", "market", "copper", "window")))
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.lit(seed), "id", k), F.lit(10)) + 1).cast("int"))
    sentence = lambda s: F.concat(F.initcap(pick(s * 8)), *(F.concat(F.lit(" "), pick(s * 8 + j)) for j in range(1, 7)), F.lit("."))
    return spark.range(files).select(F.col("id").alias("file"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(sentences)), sentence), " ").alias("text"))
