"""Names and path patterns: brace groups, suffixes that make names unique."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def expand_braces(pattern: str) -> list[str]:
    """All patterns that ``{a,b}`` groups stand for, nested ones too; a group of one item is kept as it is.

    Spark's path globs know such groups themselves; this is for filters on names.
    """
    depth, start, commas = 0, -1, []
    for k, c in enumerate(pattern):
        if c == "{":
            if depth == 0:
                start, commas = k, []
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0 and commas:
                edges = [start, *commas, k]
                items = [pattern[a + 1 : b] for a, b in zip(edges, edges[1:], strict=False)]
                return [out for item in items for out in expand_braces(pattern[:start] + item + pattern[k + 1 :])]
        elif c == "," and depth == 1:
            commas.append(k)
    return [pattern]


def looks_like_regex(pattern: str) -> bool:
    """Whether a glob was more likely meant as a regular expression."""
    return bool(re.search(r"\\[.dwsb]|\.\*|\.\+|^\^|\$$|\(\?|\|", pattern))


def glob_to_regex(pattern: str) -> str:
    """A glob with ``*``, ``?`` and brace groups as a Java regular expression for whole names."""
    def one(glob: str) -> str:
        return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.sub(r"([\\.\[\]{}()+^$|])", r"\\\1", c) for c in glob)

    return "^(?:" + "|".join(map(one, expand_braces(pattern))) + ")$"


def with_suffixes(names: DataFrame, name: str, order: list[Column], out: str = "unique_name", form: str = "_%d", first: int = 2) -> DataFrame:
    """Adds names with a suffix on repeats, in the given order: ``x``, ``x_2``, ``x_3``; form and first number may differ."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    numbered = names.withColumn("__k", k)
    return numbered.withColumn(out, F.when(F.col("__k") == 1, F.col(name)).otherwise(F.concat(name, F.format_string(form, F.col("__k") - 2 + first)))).drop("__k")


def unique_paths(paths: DataFrame, path: str, order: list[Column], out: str = "unique_path") -> DataFrame:
    """Adds paths in which a repeat's stem gets ``(1)``, ``(2)`` before the extension."""
    k = F.row_number().over(Window.partitionBy(path).orderBy(*order)) - 1
    numbered = paths.withColumn("__k", k)
    again = F.regexp_replace(F.col(path), r"^(.*?)(\.[^./]*)?$", "$1\u0001$2")
    marked = F.replace(again, F.lit("\u0001"), F.format_string("(%d)", F.col("__k")))
    return numbered.withColumn(out, F.when(F.col("__k") == 0, F.col(path)).otherwise(marked)).drop("__k")


def part_name(prefix: str, part: Column, parts: int) -> Column:
    """``prefix-NN``, zero-padded to the width of the number of parts, at least two."""
    return F.concat(F.lit(prefix + "-"), F.lpad(part.cast("string"), max(2, len(str(parts))), "0"))
