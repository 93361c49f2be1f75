"""Reading semi-structured files: kinds, records, inferred types."""

from __future__ import annotations

import csv
import json
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.errors import DataError
from loamgrid.functions import lattice
from loamgrid.functions.names import header_names

KINDS = {"json": (".json", ".ndjson", ".jsonl"), "csv": (".csv", ".tsv", ".txt"), "excel": (".xlsx", ".xlsm"), "parquet": (".parquet",), "orc": (".orc",)}
#: Characters that a delimiter is guessed from, and the candidates.
SNIFF_CHARS, DELIMITERS = 8192, ",;\t|"
#: What items that are not objects are wrapped as.
VALUE = "value"


@dataclass
class Source:
    """A lazy frame and what is known of where it came from."""

    frame: DataFrame
    kind: str
    origin: str
    root: str = ""
    delimiter: str = ""
    notes: list[str] = field(default_factory=list)


def detect_kind(path: str, given: str | None = None) -> str:
    if given:
        if given not in KINDS:
            raise DataError(f"Unknown kind {given!r}.")
        return given
    suffix = PurePosixPath(path).suffix.lower()
    for kind, suffixes in KINDS.items():
        if suffix in suffixes:
            return kind
    raise DataError(f"Cannot tell the kind of {path!r} from its name; give it.")


def read_text(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, text) of whole files."""
    files = spark.read.format("binaryFile").load(path)
    text = F.make_valid_utf8(F.col("content").cast("string")) if encoding.upper() in ("UTF-8", "UTF8") else F.decode("content", encoding)
    return files.select("path", text.alias("text"))


# --- records in documents ---------------------------------------------------------------------------------------------


def root_candidates(schema: T.DataType, path: str = "") -> list[tuple[str, int]]:
    """(path, number of keys) of the lists of objects reached through objects alone."""
    found = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            at = f"{path}.{f.name}" if path else f.name
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                found.append((at, len(f.dataType.elementType.fields)))
            found += root_candidates(f.dataType, at)
    return found


def _at(schema: T.DataType, path: str) -> T.DataType:
    for step in path.split("."):
        if not isinstance(schema, T.StructType) or step not in schema.names:
            raise DataError(f"There is no {step!r} on the way to {path!r}.")
        schema = schema[step].dataType
    return schema


def records_from(frame: DataFrame, root: str | None = None) -> tuple[DataFrame, str, list[str]]:
    """The rows that a frame of documents holds: (frame, root, notes).

    ``root`` names a list or an object.  Without it the only list of objects is
    taken, several are an error, and with none each document is a row.
    """
    notes = []
    if not root:
        found = root_candidates(frame.schema)
        if len(found) > 1:
            raise DataError("Several lists could be the rows: " + ", ".join(p for p, _ in found) + ". Choose one as root.")
        if not found:
            return frame, "", notes
        root = found[0][0]
        notes.append(f"rows taken from {root}")
    kind, column = _at(frame.schema, root), F.col(".".join(f"`{s}`" for s in root.split(".")))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StructType):
            return frame.select(F.inline(column)), root, notes
        return frame.select(F.explode(column).alias(VALUE)), root, notes
    if isinstance(kind, T.StructType):
        return frame.select(*(column[f"`{n}`" if "." in n else n].alias(n) for n in kind.names)), root, notes
    return frame.select(column.alias(VALUE)), root, notes


def read_json(spark: SparkSession, path: str, root: str | None = None) -> Source:
    """Lines of JSON where the first ones are documents of their own, so that a large file is split; else whole files."""
    lines = path.endswith((".ndjson", ".jsonl"))
    if not lines:
        first = spark.read.text(path).filter(F.trim("value") != "").select(F.get_json_object("value", "$").isNotNull()).limit(2).collect()
        lines = bool(first) and all(row[0] for row in first)
    frame = spark.read.option("multiLine", str(not lines).lower()).json(path)
    if "_corrupt_record" in frame.columns:
        raise DataError(f"{path} is neither JSON nor lines of JSON.")
    out, root_, notes = records_from(frame, root)
    return Source(out, "json", path, root_, notes=notes)


def read_variants(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Documents as variants, in which an absent key and a null one stay apart."""
    raw = spark.read.text(path) if lines else spark.read.option("wholetext", "true").text(path)
    return raw.filter(F.trim("value") != "").select(F.try_parse_json("value").alias("v"))


# --- CSV --------------------------------------------------------------------------------------------------------------


def sniff_delimiter(head: str, path: str = "", given: str | None = None) -> str:
    if given:
        return "\t" if given in ("\\t", "tab") else given
    if path.lower().endswith(".tsv"):
        return "\t"
    try:
        return csv.Sniffer().sniff(head[:SNIFF_CHARS], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def infer_columns(frame: DataFrame) -> dict[str, tuple[str, bool]]:
    """Type of each text column, and whether whole numbers in it need more than 64 bits, in one aggregate."""
    aggs = []
    for k, c in enumerate(frame.columns):
        cell = F.col(f"`{c}`")
        number = F.when(lattice.cell_bit(cell) == lattice.BIT["int"], lattice.ascii_digits(lattice.trimmed(cell)))
        aggs += [F.bit_or(lattice.cell_bit(cell)).alias(f"b{k}"), F.coalesce(F.bool_or(number.isNotNull() & number.try_cast("bigint").isNull()), F.lit(False)).alias(f"w{k}")]
    row = frame.agg(*aggs).first()
    return {c: (lattice.resolve(row[f"b{k}"] or 0), row[f"w{k}"]) for k, c in enumerate(frame.columns)}


def typed(frame: DataFrame) -> DataFrame:
    """A frame of text with each column as its inferred type: all its cells agree or it stays text."""
    kinds = infer_columns(frame)
    return frame.select(*(lattice.cell_value(F.col(f"`{c}`"), kind, wide).alias(c) for c, (kind, wide) in kinds.items()))


def untyped(frame: DataFrame) -> DataFrame:
    """Trimmed text, blanks null."""
    return frame.select(*(F.nullif(lattice.trimmed(F.col(f"`{c}`")), F.lit("")).alias(c) for c in frame.columns))


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether some quoted cell may go on in the next line: the line it begins in holds an odd number of quotes."""
    quotes = F.char_length(F.regexp_replace("value", '[^"]+', ""))
    return bool(spark.read.text(path).agg(F.bool_or(quotes % 2 == 1)).first()[0])


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, infer: bool = True, encoding: str = "UTF-8") -> Source:
    """A CSV file: names from its first row, short rows padded, long ones cut, blank ones dropped.

    One task reads a whole file only where a cell spans lines or the encoding is
    not UTF-8; any other file is split.
    """
    head = spark.read.option("encoding", encoding).text(path).limit(50).collect()  # the delimiter's sample
    if not head:
        raise DataError(f"{path} is empty.")
    sep = sniff_delimiter("\n".join(r[0] for r in head), path, delimiter)
    whole = encoding.upper().replace("-", "") != "UTF8" or spans_lines(spark, path)
    reader = spark.read.option("sep", sep).option("encoding", encoding).option("multiLine", str(whole).lower()).option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("nullValue", "")
    cells = next(csv.reader([head[0][0].lstrip("﻿")], delimiter=sep))
    names = header_names(cells)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    frame = reader.option("header", "true").option("enforceSchema", "true").option("mode", "PERMISSIVE").schema(schema).csv(path)
    frame = frame.filter(F.coalesce(*(F.nullif(lattice.trimmed(F.col(f"`{n}`")), F.lit("")) for n in names)).isNotNull())
    return Source(typed(frame) if infer else untyped(frame), "csv", path, delimiter=sep)


def read_excel(spark: SparkSession, path: str, sheet: str | None = None, infer: bool = True) -> Source:
    """A workbook's sheet with the types it recorded; needs openpyxl."""
    try:
        import openpyxl
    except ImportError as error:
        raise DataError("Reading a workbook needs openpyxl, which is not installed.") from error
    book = openpyxl.load_workbook(path, read_only=True, data_only=True)
    if sheet and sheet not in book.sheetnames:
        raise DataError(f"No sheet {sheet!r}; there are: {', '.join(book.sheetnames)}.")
    rows = [r for r in (book[sheet] if sheet else book.active).iter_rows(values_only=True) if any(str(c).strip() for c in r if c is not None)]
    if not rows:
        raise DataError(f"{path} is empty.")
    names = header_names([None if c is None else str(c) for c in rows[0]])
    body = [[None if isinstance(c, str) and not c.strip() else c for c in (*r, *[None] * len(names))[: len(names)]] for r in rows[1:]]
    if not infer:
        body = [[None if c is None else str(c) for c in r] for r in body]
    text = spark.createDataFrame([[None if c is None else json.dumps(c, default=str) if isinstance(c, bool) else str(c) for c in r] for r in body] or [[None] * len(names)], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return Source(typed(text) if infer else text, "excel", path)


def load(spark: SparkSession, path: str, kind: str | None = None, root: str | None = None, delimiter: str | None = None, sheet: str | None = None, infer: bool = True, limit: int | None = None) -> Source:
    """A file of any kind as a lazy frame; ``limit`` keeps the first rows, below zero all."""
    kind = detect_kind(path, kind)
    if root and kind != "json":
        raise DataError("A root is for JSON.")
    if kind == "json":
        out = read_json(spark, path, root)
    elif kind == "csv":
        out = read_csv(spark, path, delimiter, infer)
    elif kind == "excel":
        out = read_excel(spark, path, sheet, infer)
    else:
        out = Source(spark.read.format(kind).load(path), kind, path)
    if limit is not None and limit >= 0:
        out.frame = out.frame.limit(limit)
    return out


def pattern_file(spark: SparkSession, path: str) -> DataFrame:
    """(pattern) lines without comments that begin with ``#`` or ``;``."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("pattern")).filter((F.col("pattern") != "") & ~F.col("pattern").rlike("^[#;]"))
