"""SQL text and tables from frames: DDL, literals, batched inserts."""

from __future__ import annotations

import difflib
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.errors import DataError
from loamgrid.functions import lattice
from loamgrid.functions.names import index_name, sanitize, unique_names

from . import files, profile

# Column types of each dialect by lattice type.
TYPES = {
    "sqlite": {"null": "TEXT", "bool": "INTEGER", "int": "INTEGER", "float": "REAL", "date": "TEXT", "datetime": "TEXT", "str": "TEXT", "json": "TEXT", "wide": "TEXT"},
    "postgres": {"null": "text", "bool": "boolean", "int": "bigint", "float": "double precision", "date": "date", "datetime": "timestamp", "str": "text", "json": "jsonb", "wide": "numeric"},
}
BATCH = 100


@dataclass(frozen=True)
class Table:
    """What is to be made of a frame."""

    name: str
    key: tuple[str, ...] = ()
    indexes: tuple[tuple[str, ...], ...] = ()
    unique_indexes: tuple[tuple[str, ...], ...] = ()
    if_exists: str = "fail"
    nested: str = "json"
    batch: int = BATCH
    dialect: str = "sqlite"

    def __post_init__(self) -> None:
        if self.dialect not in TYPES:
            raise DataError(f"Unknown dialect {self.dialect!r}. Known dialects: {', '.join(sorted(TYPES))}.")
        if self.if_exists not in ("fail", "replace", "append"):
            raise DataError(f"Unknown mode {self.if_exists!r}.")


@dataclass(frozen=True)
class Field:
    name: str
    source: str
    type: str
    nullable: bool = True
    wide: bool = field(default=False)


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def parse_renames(pairs: Iterable[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for pair in pairs:
        old, sep, new = pair.partition("=")
        if not sep or not old.strip() or not new.strip():
            raise DataError(f"A rename is OLD=NEW, not {pair!r}.")
        if old.strip() in out:
            raise DataError(f"{old.strip()!r} is renamed twice.")
        out[old.strip()] = new.strip()
    return out


def fields_of(frame: DataFrame, renames: dict[str, str] | None = None, raw: bool = False) -> list[Field]:
    """Columns as a table would hold them, nulls and wide numbers found by one aggregate each."""
    renames = dict(renames or {})
    names = unique_names(frame.columns, raw)
    kinds = profile.kinds(frame)
    left = set(renames)
    final = []
    for source, name in zip(frame.columns, names, strict=True):
        hit = next((k for k in (source, name) if k in renames), None)
        left.discard(hit)
        final.append(renames[hit] if hit else name)
    if left:
        raise DataError(f"No such column: {', '.join(sorted(left))}." + _near(sorted(left)[0], [*frame.columns, *names]))
    if len(set(final)) < len(final):
        raise DataError("Two columns would have one name.")
    # numbers that are not finite are written as NULL
    finite = lambda c: F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), c)
    counted = [finite(F.col(f"`{c}`")) if kinds[c] == "float" else F.col(f"`{c}`") for c in frame.columns]
    counts = frame.agg(F.count("*").alias("n"), *(F.count(c).alias(f"c{k}") for k, c in enumerate(counted))).first()
    wide = {r["field"] for r in profile.wide_columns(frame).filter("wide").collect()} if "int" in kinds.values() else set()
    return [Field(n, s, "null" if counts[k + 1] == 0 else kinds[s], counts[k + 1] < counts[0], s in wide) for k, (s, n) in enumerate(zip(frame.columns, final, strict=True))]


def _near(name: str, known: list[str]) -> str:
    close = difflib.get_close_matches(name, known, 3, 0.5)
    return f" Did you mean: {', '.join(close)}?" if close else ""


def sql_type(f: Field, table: Table) -> str:
    types = TYPES[table.dialect]
    if f.type in ("list", "object", "json"):
        return "text" if table.dialect == "postgres" and table.nested == "text" else types["json"]
    return types["wide"] if f.wide and f.type == "int" else types[f.type]


def create_table(table: Table, fields: list[Field]) -> str:
    """The statements that make the table."""
    width = max((len(quote(f.name)) for f in fields), default=0)
    lines = [f"    {quote(f.name).ljust(width)} {sql_type(f, table)}{'' if f.nullable and f.name not in table.key else ' NOT NULL'}" for f in fields]
    if table.key:
        lines.append(f"    PRIMARY KEY ({', '.join(map(quote, table.key))})")
    drop = f"DROP TABLE IF EXISTS {quote(table.name)};\n" if table.if_exists == "replace" else ""
    exists = "IF NOT EXISTS " if table.if_exists == "append" else ""
    return f"{drop}CREATE TABLE {exists}{quote(table.name)} (\n" + ",\n".join(lines) + "\n);"


def create_indexes(table: Table) -> str:
    both = [*((g, "") for g in table.indexes), *((g, "UNIQUE ") for g in table.unique_indexes)]
    return "\n".join(f"CREATE {word}INDEX {quote(index_name(table.name, g))} ON {quote(table.name)} ({', '.join(map(quote, g))});" for g, word in both)


def validate(frame: DataFrame, table: Table, fields: list[Field]) -> None:
    """Refuse keys and indexes that name no column or a container, and keys that the data break."""
    by_name = {f.name: f for f in fields}
    for name in {n for group in (table.key, *table.indexes, *table.unique_indexes) for n in group}:
        if name not in by_name:
            raise DataError(f"No such column: {name}." + _near(name, list(by_name)))
        if by_name[name].type in ("list", "object", "json"):
            raise DataError(f"{name} holds containers and cannot be a key or an index.")
    if table.key:
        bad = profile.key_problems(frame, [by_name[k].source for k in table.key]).first()
        if bad["null_rows"]:
            raise DataError(f"The primary key is null in {bad['null_rows']} rows.")
        if bad["repeated_keys"]:
            raise DataError(f"{bad['repeated_keys']} primary keys occur more than once.")


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def literal(f: Field, table: Table, kind: str | None = None) -> Column:
    """A value of the field as a SQL literal; numbers that are not finite become NULL."""
    c = F.col(f"`{f.source}`")
    if f.type == "bool":
        yes, no = ("1", "0") if table.dialect == "sqlite" else ("TRUE", "FALSE")
        text = F.when(c, yes).otherwise(no)
    elif f.type == "int":
        text = c.cast("string")
    elif f.type == "float":
        text = F.when(F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), "NULL").otherwise(c.cast("string"))
    elif f.type == "date":
        text = _quoted(F.date_format(c, "yyyy-MM-dd"))
    elif f.type == "datetime":
        micros = F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1000000))
        text = _quoted(F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros > 0, F.format_string(".%06d", micros)).otherwise("")))
    elif f.type in ("list", "object", "json"):
        text = _quoted(F.to_json(c))
        if table.dialect == "postgres" and table.nested != "text":
            text = F.concat(text, F.lit("::jsonb"))
    else:
        text = _quoted(c.cast("string"))
    return F.when(c.isNull(), "NULL").otherwise(text)


def insert_batches(frame: DataFrame, table: Table, fields: list[Field], order: list[Column]) -> DataFrame:
    """(batch, statement): multi-row INSERTs of ``table.batch`` rows in the given order."""
    head = f"INSERT INTO {quote(table.name)} ({', '.join(quote(f.name) for f in fields)}) VALUES\n"
    tuple_ = F.concat(F.lit("    ("), F.concat_ws(", ", *(literal(f, table) for f in fields)), F.lit(")"))
    rows = files.ranked(frame.withColumn("__tuple", tuple_), order, "__row").select(F.floor(F.col("__row") / table.batch).cast("long").alias("batch"), F.struct("__row", "__tuple").alias("t"))
    texts = F.transform(F.array_sort(F.collect_list("t")), lambda t: t["__tuple"])
    return rows.groupBy("batch").agg(F.concat(F.lit(head), F.array_join(texts, ",\n"), F.lit(";")).alias("statement"))


def script(frame: DataFrame, table: Table, order: list[Column], renames: dict[str, str] | None = None, origin: str = "input") -> DataFrame:
    """(part, statement): the whole script as rows to be written in the order of ``part``."""
    fields = fields_of(frame, renames)
    validate(frame, table, fields)
    n = frame.count()
    head = [f"-- Generated from {origin}.\n-- Dialect: {table.dialect}. {n} rows, {len(fields)} columns.", create_table(table, fields), create_indexes(table)]
    spark = frame.sparkSession
    opening = spark.createDataFrame([(k - 10, s) for k, s in enumerate([*filter(None, head), *(["BEGIN;"] if n else [])])], "part long, statement string")
    if not n:
        return opening
    body = insert_batches(frame, table, fields, order).withColumnRenamed("batch", "part")
    return opening.unionByName(body).unionByName(spark.createDataFrame([((1 << 62), "COMMIT;")], "part long, statement string"))


def parameters(frame: DataFrame) -> DataFrame:
    """Values as a database driver binds them: booleans as 0 and 1, containers as JSON, times as ISO text."""
    kinds, out = profile.kinds(frame), []
    for name in frame.columns:
        c, kind = F.col(f"`{name}`"), kinds[name]
        if kind == "bool":
            c = c.cast("int")
        elif kind in ("list", "object", "json"):
            c = F.to_json(c)
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "datetime":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind == "float":
            c = c.cast("double")
        elif frame.schema[name].dataType.simpleString().startswith("decimal"):
            c = F.coalesce(c.try_cast("bigint").cast("string"), c.cast("string"))
        out.append(c.alias(name))
    return frame.select(*out)


def save_table(frame: DataFrame, table: Table, renames: dict[str, str] | None = None) -> None:
    """Write a Spark table under the rules of ``if_exists``, validated first."""
    fields = fields_of(frame, renames)
    validate(frame, table, fields)
    mode = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}[table.if_exists]
    frame.select(*(F.col(f"`{f.source}`").alias(f.name) for f in fields)).write.mode(mode).saveAsTable(table.name)


def default_table_name(path: str) -> str:
    return sanitize(path.rstrip("/").rpartition("/")[2].rpartition(".")[0] or path)


def rename_plan(columns: list[str], pairs: Iterable[str]) -> dict[str, str]:
    """Renames resolved against columns: exactly, then case aside, then as identifiers; swaps are allowed."""
    out: dict[str, str] = {}
    for old, new in parse_renames(pairs).items():
        found = [c for c in columns if c == old] or [c for c in columns if c.casefold() == old.casefold()] or [c for c in columns if sanitize(c) == sanitize(old)]
        if len(found) != 1:
            raise DataError(f"{'No such column' if not found else 'Several columns fit'}: {old}." + ("" if found else _near(old, columns)))
        if found[0] in out:
            raise DataError(f"{found[0]!r} is renamed twice.")
        if found[0] != new:
            out[found[0]] = new
    final = [out.get(c, c) for c in columns]
    if twice := {c for c in final if final.count(c) > 1}:
        raise DataError(f"Two columns would be named {', '.join(sorted(twice))}.")
    return out


def renamed(frame: DataFrame, pairs: Iterable[str]) -> DataFrame:
    plan = rename_plan(frame.columns, pairs)
    return frame.toDF(*(plan.get(c, c) for c in frame.columns))


def lattice_type(frame: DataFrame, name: str) -> str:
    return lattice.of_spark(frame.schema[name].dataType.simpleString())
