"""Calendar-aware intervals: parsing, applying and formatting."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.errors import DataError

# Unit spellings; "m" alone is minutes.
UNITS = {
    "years": ("year", "years", "yr", "yrs", "y"), "months": ("month", "months", "mon", "mons", "mo"), "weeks": ("week", "weeks", "wk", "wks", "w"), "days": ("day", "days", "d"),
    "hours": ("hour", "hours", "hr", "hrs", "h"), "minutes": ("minute", "minutes", "min", "mins", "m"), "seconds": ("second", "seconds", "sec", "secs", "s"),
}
_UNIT_OF = {spelling: unit for unit, spellings in UNITS.items() for spelling in spellings}
_SECONDS = {"weeks": 604800, "days": 86400, "hours": 3600, "minutes": 60, "seconds": 1}
_PIECE = r"[+-]?\d+:\d{2}(?::\d{2}(?:\.\d+)?)?|[+-]?\d+(?:\.\d+)?\s*[A-Za-z]+"


@dataclass(frozen=True)
class Interval:
    """Whole months and exact days and seconds, never folded into each other."""

    months: int = 0
    days: float = 0.0
    seconds: float = 0.0


def parse_interval(text: str) -> Interval:
    """An interval such as ``1 y 2 mon``, ``-3.4 hours`` or ``1 day 02:30``."""
    if not text.strip():
        raise DataError("Interval cannot be empty.")
    if rest := re.sub(_PIECE, "", text).strip(" ,"):
        raise DataError(f"Invalid interval segment: {rest}")
    pieces = re.findall(_PIECE, text)
    if not pieces:
        raise DataError(f"Interval format not recognized: {text!r}.")
    total = dict.fromkeys(("months", "days", "seconds"), 0.0)
    for piece in pieces:
        if ":" in piece:
            sign = -1 if piece[0] == "-" else 1
            total["seconds"] += sign * sum(float(x) * w for x, w in zip(piece.lstrip("+-").split(":"), (3600, 60, 1), strict=False))
            continue
        number, word = re.fullmatch(r"([+-]?[\d.]+)\s*(\w+)", piece).groups()
        unit = _UNIT_OF.get(word.lower())
        if unit is None:
            raise DataError(f"Unknown interval unit: {word}. Known units: {', '.join(sorted(UNITS))}.")
        value = float(number)
        if unit in ("years", "months"):
            if not value.is_integer():
                raise DataError(f"{unit} must be whole numbers in interval values.")
            total["months"] += value * (12 if unit == "years" else 1)
        elif unit in ("weeks", "days"):
            total["days"] += value * (7 if unit == "weeks" else 1)
        else:
            total["seconds"] += value * _SECONDS[unit]
    return Interval(int(total["months"]), total["days"], total["seconds"])


def interval_columns(text: Column) -> tuple[Column, Column]:
    """(months, seconds) of an interval column; both null where it is not one."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    bad = F.trim(F.regexp_replace(F.regexp_replace(text, _PIECE, ""), "[ ,]+", " ")) != ""
    unit = lambda p: F.lower(F.regexp_extract(p, r"([A-Za-z]+)$", 1))
    value = lambda p: F.regexp_extract(p, r"^([+-]?\d+(?:\.\d+)?)", 1).try_cast("double")

    def months(p: Column) -> Column:
        return F.when(unit(p).isin(*UNITS["years"]), value(p) * 12).when(unit(p).isin(*UNITS["months"]), value(p)).otherwise(0.0)

    def clock(p: Column) -> Column:
        hms = F.split(F.regexp_replace(p, "^[+-]", ""), ":")
        total = hms[0].try_cast("double") * 3600 + F.try_element_at(hms, F.lit(2)).try_cast("double") * 60 + F.coalesce(F.try_element_at(hms, F.lit(3)).try_cast("double"), F.lit(0.0))
        return total * F.when(p.startswith("-"), -1).otherwise(1)

    def seconds(p: Column) -> Column:
        out = F.when(F.instr(p, ":") > 0, clock(p))
        for name, weight in _SECONDS.items():
            out = out.when(unit(p).isin(*UNITS[name]), value(p) * weight)
        return out.otherwise(0.0)

    known = F.forall(pieces, lambda p: (F.instr(p, ":") > 0) | (unit(p).isin(*_UNIT_OF) & (~unit(p).isin(*UNITS["years"], *UNITS["months"]) | (value(p) % 1 == 0))))
    good = ~bad & (F.size(pieces) > 0) & known
    total = lambda f: F.when(good, F.aggregate(pieces, F.lit(0.0), lambda acc, p: acc + f(p)))
    return total(months).cast("long"), total(seconds)


def apply_interval(at: Column, interval: Interval, direction: int = 1) -> Column:
    """Shift by months with the day clamped to the month, then by the exact rest."""
    micros = round(direction * (interval.days * 86400 + interval.seconds) * 1_000_000)
    shifted = F.timestamp_add("MONTH", F.lit(direction * interval.months), at)
    return F.timestamp_add("MICROSECOND", F.lit(micros), shifted)


def format_duration(seconds: Column) -> Column:
    """``1d 2h 3m 4s``, zero parts left out; seconds are rounded half to even."""
    whole = F.abs(F.bround(seconds)).cast("long")
    counted = [(F.floor(whole / 86400), "d"), (F.floor(whole % 86400 / 3600), "h"), (F.floor(whole % 3600 / 60), "m")]
    named = [F.when(n > 0, F.concat(n.cast("string"), F.lit(u))) for n, u in counted]
    last = F.when((whole % 60 > 0) | (whole == 0), F.concat((whole % 60).cast("string"), F.lit("s")))
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.concat_ws(" ", *named, last))


def format_hours_minutes(hours: Column) -> Column:
    minutes = F.bround(F.abs(hours) * 60).cast("long")
    return F.concat(F.when(hours < 0, "-").otherwise(""), F.format_string("%02d:%02d", F.floor(minutes / 60), minutes % 60))


def format_total(value: Column) -> Column:
    """A number without trailing zeros, six decimals at most."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
