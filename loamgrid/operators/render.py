"""Small results as text, and results of any size as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.errors import DataError

#: Rows that a rendered table may have; larger results are written by Spark.
MOST_ROWS = 100_000


def _cells(frame: DataFrame) -> list[list[str]]:
    rows = frame.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise DataError(f"A text table has at most {MOST_ROWS:,} rows; write the frame instead.")
    show = lambda v: "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    return [[show(v) for v in row] for row in rows]


def text_table(frame: DataFrame) -> str:
    """Aligned columns under a header and a rule."""
    body = _cells(frame)
    widths = [max(map(len, column)) for column in zip(frame.columns, *body, strict=True)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
    return "\n".join([line(frame.columns), "-+-".join("-" * w for w in widths), *map(line, body)])


def markdown_table(frame: DataFrame) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(frame.columns), line(["---"] * len(frame.columns)), *map(line, _cells(frame))])


def json_lines(frame: DataFrame) -> DataFrame:
    """(value): each row as a JSON object, nulls kept."""
    return frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write(frame: DataFrame, path: str, form: str, append: bool = False) -> None:
    """Write as csv (header, nulls empty), json, parquet, orc or text."""
    writer = frame.write.mode("append" if append else "errorifexists")
    if form == "csv":
        writer.option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)
    elif form in ("json", "parquet", "orc", "text"):
        getattr(writer, form)(path)
    else:
        raise DataError(f"Unknown form {form!r}.")


def write_excel(frame: DataFrame, path: str) -> None:
    """A workbook with widths of at most 60; needs openpyxl."""
    try:
        import openpyxl
    except ImportError as error:
        raise DataError("Writing a workbook needs openpyxl, which is not installed.") from error
    book = openpyxl.Workbook()
    sheet, body = book.active, _cells(frame)
    for row in [frame.columns, *body]:
        sheet.append(list(row))
    for k, column in enumerate(zip(frame.columns, *body, strict=True), 1):
        sheet.column_dimensions[openpyxl.utils.get_column_letter(k)].width = min(60, max(map(len, column)) + 2)
    book.save(path)
