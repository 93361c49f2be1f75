"""Profiles: one row for each column, in one pass over the values."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.errors import DataError
from loamgrid.functions import lattice


def kinds(frame: DataFrame) -> dict[str, str]:
    """The lattice type of each column."""
    return {f.name: lattice.of_spark(f.dataType.simpleString()) for f in frame.schema}


def _as_text(name: str, kind: str) -> Column:
    column = F.col(f"`{name}`")
    return F.to_json(column) if kind in ("list", "object", "json") else column.cast("string")


def value_counts(frame: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(field, value, n) with values as text.

    The first of two levels: counting values first makes distinct counts and top
    values plain aggregates, where one countDistinct a column would copy every row
    once a column.
    """
    own = kinds(frame)
    names = list(columns or frame.columns)
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), _as_text(c, own[c]).alias("value")) for c in names))
    return frame.select(F.explode(pairs).alias("p")).select("p.field", "p.value").groupBy("field", "value").agg(F.count("*").alias("n"))


def distinct_and_top(frame: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(field, non_null, nulls, distinct, top, top_count).

    Of equally frequent values the smallest is the top one; there is none when
    nothing occurs twice.
    """
    counts = value_counts(frame, columns)
    some = F.col("value").isNotNull()
    # the smallest of the most frequent
    top = F.min_by(F.when(some, F.struct("value", "n")), F.when(some, F.struct((-F.col("n")).alias("n"), "value")))
    out = counts.groupBy("field").agg(
        F.sum(F.when(some, F.col("n")).otherwise(0)).alias("non_null"), F.sum(F.when(~some, F.col("n")).otherwise(0)).alias("nulls"), F.count_if(some).alias("distinct"), top.alias("t"),
    )
    repeated = F.col("t.n") > 1
    return out.select("field", "non_null", "nulls", "distinct", F.when(repeated, F.col("t.value")).alias("top"), F.when(repeated, F.col("t.n")).alias("top_count"))


def extremes(frame: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(field, low, high, mean, trues, falses): values for numbers, lengths for text, sizes for containers.

    One aggregate without distincts; its single row is turned into one for each field.
    """
    own = kinds(frame)
    names = list(columns or frame.columns)
    aggs = []
    for k, name in enumerate(names):
        c, kind = F.col(f"`{name}`"), own[name]
        if kind in ("int", "float"):
            low, high, mean = F.min(c).cast("string"), F.max(c).cast("string"), F.avg(c)
        elif kind in ("date", "datetime"):
            low, high, mean = F.min(c).cast("string"), F.max(c).cast("string"), F.lit(None)
        elif kind == "bool":
            low, high, mean = F.lit(None), F.lit(None), F.lit(None)
        else:
            size = F.when(c.isNotNull(), F.char_length(c) if kind == "str" else items(c, frame.schema[name].dataType))
            low, high, mean = F.min(size).cast("string"), F.max(size).cast("string"), F.avg(size)
        yes, no = (F.count_if(c), F.count_if(~c)) if kind == "bool" else (F.lit(None), F.lit(None))
        aggs.append(F.struct(F.lit(name).alias("field"), low.cast("string").alias("low"), high.cast("string").alias("high"), mean.cast("double").alias("mean"), yes.cast("long").alias("trues"), no.cast("long").alias("falses")).alias(f"f{k}"))
    one = frame.agg(*aggs)
    return one.select(F.explode(F.array(*(F.col(f"f{k}") for k in range(len(names))))).alias("f")).select("f.*")


def items(value: Column, kind: T.DataType) -> Column:
    """The number of items of a container: elements, keys, or fields with a value; a variant that is none counts one."""
    if isinstance(kind, T.ArrayType | T.MapType):
        return F.size(value)
    if isinstance(kind, T.StructType):
        return sum((value.getField(n).isNotNull().cast("int") for n in kind.names), F.lit(0))
    text = F.to_json(value)
    return F.coalesce(F.json_array_length(text), F.array_size(F.json_object_keys(text)), F.lit(1))


def summary(frame: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """The whole profile: type, counts, distinct, extremes and top value of each column."""
    own = kinds(frame)
    table = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    both = distinct_and_top(frame, columns).join(extremes(frame, columns), "field")
    return both.withColumn("type", table[F.col("field")])


def number_text(value: Column) -> Column:
    """A whole number bare, any other with four significant digits and no zeros at its end."""
    short = F.regexp_replace(F.format_string("%.4g", value.cast("double")), r"(\.\d*?)0+(e|$)", "$1$2")
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.regexp_replace(short, r"\.(e|$)", "$1"))


def clip(text: Column, most: int = 28) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 1)), F.lit("…")))


def key_candidates(frame: DataFrame) -> DataFrame:
    """(field) of columns that could be a key: no null, all different, no container."""
    own = kinds(frame)
    plain = [c for c in frame.columns if own[c] not in ("list", "object", "json")]
    return distinct_and_top(frame, plain).filter("nulls = 0 AND distinct = non_null AND non_null > 0").select("field")


def key_problems(frame: DataFrame, key: list[str]) -> DataFrame:
    """(rows, null_rows, repeated_keys): what stops ``key`` from being a primary key."""
    if missing := [c for c in key if c not in frame.columns]:
        raise DataError(f"No such column: {', '.join(missing)}.")
    counted = frame.groupBy(*key).agg(F.count("*").alias("n"))
    null = F.lit(False)
    for c in key:
        null = null | F.col(c).isNull()
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("null_rows"), F.count_if((F.col("n") > 1) & ~null).alias("repeated_keys"))


def select_fields(frame: DataFrame, keys: Iterable[str] = (), types: Iterable[str] = (), drop_empty: bool = False) -> DataFrame:
    """Columns whose name fits one of ``keys`` (globs, case aside) and whose type is one of ``types``.

    "json" stands for any container.  ``drop_empty`` leaves out columns without a
    value, found by one aggregate.
    """
    own, keys, types = kinds(frame), [k.lower() for k in keys], list(types)
    if unknown := [t for t in types if t not in (*lattice.TYPES, "mixed")]:
        raise DataError(f"Unknown type: {', '.join(unknown)}.")
    fits = lambda c: own[c] in types or ("json" in types and own[c] in ("list", "object"))
    names = [c for c in frame.columns if (not keys or any(fnmatch.fnmatchcase(c.lower(), k) for k in keys)) and (not types or fits(c))]
    if drop_empty and names:
        counts = frame.agg(*(F.count(f"`{c}`").alias(f"n{k}") for k, c in enumerate(names))).first()
        names = [c for c, n in zip(names, counts, strict=True) if n]
    if not names:
        raise DataError("No field matches.")
    return frame.select(*(f"`{c}`" for c in names))


def display_rows(frame: DataFrame, limit: int | None = None) -> DataFrame:
    """Values as a table shows them: containers as compact JSON, booleans as true and false."""
    own = kinds(frame)
    out = frame.select(*(_as_text(c, own[c]).alias(c) if own[c] in ("list", "object", "json", "bool") else F.col(f"`{c}`") for c in frame.columns))
    return out if limit is None or limit < 0 else out.limit(limit)


def wide_columns(frame: DataFrame) -> DataFrame:
    """(field, wide) for whole-number columns: whether a value lies outside 64 bits."""
    names = [f.name for f in frame.schema if lattice.of_spark(f.dataType.simpleString()) == "int"]
    limit = F.lit("9223372036854775807").cast("decimal(38,0)")
    wide = [F.coalesce(F.bool_or(F.abs(F.col(f"`{c}`").cast("decimal(38,0)")) > limit), F.lit(False)) for c in names]
    one = frame.agg(*(F.struct(F.lit(c).alias("field"), w.alias("wide")).alias(f"f{k}") for k, (c, w) in enumerate(zip(names, wide, strict=True))))
    return one.select(F.explode(F.array(*(F.col(f"f{k}") for k in range(len(names))))).alias("f")).select("f.*")
