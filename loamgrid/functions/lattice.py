"""The type lattice: one bit for each type, so that unifying is a bitwise or.

null < {bool, int < float, date < datetime} < str, and {list, object} < json; a
container with anything else is json, any other disagreement is str.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("null", "bool", "int", "float", "date", "datetime", "str", "list", "object", "json")
BIT = {name: 1 << k for k, name in enumerate(TYPES)}
_CONTAINERS = BIT["list"] | BIT["object"] | BIT["json"]

# Words of a cell that mean a boolean or nothing.
TRUE_WORDS, FALSE_WORDS = ("true", "yes"), ("false", "no")
NULL_WORDS = ("", "null", "none", "nan", "n/a", "na")

_INT = r"(?U)^[+-]?\d+\z"
_FLOAT = r"(?U)^[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?\z"
#: How a number, a date or a time must begin: most text is told apart by this alone.
_MAYBE = r"(?U)^[+-]?\.?\d"
_ZERO_FIRST = r"^[+-]*0(?!\.)."
_DATE = r"(?U)^\d{4}-\d{2}-\d{2}\z"
_DATETIME = r"(?U)^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?\z"


def resolve(bits: int) -> str:
    """The type that holds all types whose bits are set."""
    bits &= ~BIT["null"]
    if bits == 0:
        return "null"
    for name in TYPES:
        if bits == BIT[name]:
            return name
    if bits & _CONTAINERS:
        return "json"
    if bits == BIT["int"] | BIT["float"]:
        return "float"
    if bits == BIT["date"] | BIT["datetime"]:
        return "datetime"
    return "str"


def unify(types: Iterable[str]) -> str:
    bits = 0
    for name in types:
        bits |= BIT[name]
    return resolve(bits)


def resolved(bits: Column) -> Column:
    """``resolve`` of a bit column."""
    own = bits.bitwiseAND(~BIT["null"])
    out = F.when(own == 0, "null")
    for name in TYPES[1:]:
        out = out.when(own == BIT[name], name)
    out = out.when(own.bitwiseAND(_CONTAINERS) != 0, "json").when(own == BIT["int"] | BIT["float"], "float").when(own == BIT["date"] | BIT["datetime"], "datetime")
    return out.otherwise("str")


def type_label(bits: int) -> str:
    """All types but null, in lattice order."""
    return "|".join(n for n in TYPES if n != "null" and bits & BIT[n]) or "null"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")


def _moment(text: Column) -> Column:
    value = F.replace(ascii_digits(text), F.lit(" "), F.lit("T"))
    value = F.regexp_replace(value, r"([+-]\d{2})(\d{2})\z", "$1:$2")
    return F.coalesce(*(F.try_to_timestamp(value, F.lit(form)) for form in ("yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS][XXX]", "yyyy-MM-dd'T'HH:mm[:ss][.SSSSS][XXX]", "yyyy-MM-dd'T'HH:mm[:ss][.SSSS][XXX]", "yyyy-MM-dd'T'HH:mm[:ss][.SSS][XXX]", "yyyy-MM-dd'T'HH:mm[:ss][.SS][XXX]", "yyyy-MM-dd'T'HH:mm[:ss][.S][XXX]")))


def cell_bit(text: Column) -> Column:
    """The type bit of a cell of text; leading zeros keep it text, impossible dates too."""
    value = trimmed(text)
    word = F.lower(value)
    zero = value.rlike(_ZERO_FIRST)
    return (
        F.when(text.isNull() | word.isin(*NULL_WORDS), BIT["null"]).when(word.isin(*TRUE_WORDS, *FALSE_WORDS), BIT["bool"])
        .when(~value.rlike(_MAYBE), BIT["str"])
        .when(value.rlike(_INT) & ~zero, BIT["int"]).when(value.rlike(_FLOAT) & ~zero, BIT["float"])
        .when(value.rlike(_DATE) & ascii_digits(value).try_cast("date").isNotNull(), BIT["date"]).when(value.rlike(_DATETIME) & _moment(value).isNotNull(), BIT["datetime"])
        .otherwise(BIT["str"])
    )


def cell_value(text: Column, kind: str, wide: bool = False) -> Column:
    """A cell as a value of its column's type.

    In a column that stays text only blanks are null; integers beyond 64 bits
    become decimals when ``wide``.
    """
    value, word = ascii_digits(trimmed(text)), F.lower(trimmed(text))
    some = lambda c: F.when(~word.isin(*NULL_WORDS), c)
    if kind == "bool":
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    if kind == "int":
        return some(value.try_cast("decimal(38,0)" if wide else "bigint"))
    if kind == "float":
        return some(value.try_cast("double"))
    if kind == "date":
        return some(value.try_cast("date"))
    if kind == "datetime":
        return some(F.coalesce(_moment(value), value.try_cast("timestamp")))
    return F.when(trimmed(text) != "", text)


#: Lattice types of Spark's own, by the start of their names.
_SPARK = (("boolean", "bool"), ("tinyint", "int"), ("smallint", "int"), ("int", "int"), ("bigint", "int"), ("float", "float"), ("double", "float"), ("decimal", "float"), ("date", "date"), ("timestamp", "datetime"), ("array", "list"), ("struct", "object"), ("map", "object"), ("variant", "json"), ("void", "null"), ("interval", "str"))


def of_spark(simple: str) -> str:
    """The lattice type of a Spark type's simple name; a decimal without fraction is an int."""
    if simple.startswith("decimal") and simple.endswith(",0)"):
        return "int"
    return next((kind for start, kind in _SPARK if simple.startswith(start)), "str")
