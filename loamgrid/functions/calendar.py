"""Gregorian and Jalali calendar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.errors import DataError

# Month and weekday names; weekdays in each calendar's own order.
GREGORIAN_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
JALALI_MONTHS = ("Farvardin", "Ordibehesht", "Khordad", "Tir", "Mordad", "Shahrivar", "Mehr", "Aban", "Azar", "Dey", "Bahman", "Esfand")
JALALI_MONTHS_FA = ("فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور", "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند")
GREGORIAN_WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
JALALI_WEEKDAYS = ("Shanbeh", "Yekshanbeh", "Doshanbeh", "Seshanbeh", "Chaharshanbeh", "Panjshanbeh", "Jomeh")
JALALI_WEEKDAYS_FA = ("شنبه", "یکشنبه", "دوشنبه", "سه‌شنبه", "چهارشنبه", "پنجشنبه", "جمعه")
#: Years at which the Jalali leap cycle breaks.
BREAKS = (-61, 9, 38, 199, 426, 686, 756, 818, 1111, 1181, 1210, 1635, 2060, 2097, 2192, 2262, 2324, 2394, 2456, 3178)

#: Days in 33 Jalali years, in four of them, and what 1 Farvardin 979 lies after 1600-01-01.
_CYCLE, _FOUR, _SHIFT = 12053, 1461, 79


def _div(value: Column, by: int) -> Column:
    """Division that rounds down, below zero too."""
    return F.floor(value / by).cast("long")


def to_jalali(day: Column) -> Column:
    """struct<year, month, day> of a date.

    The days since 1600-01-01 are counted off in 33-year cycles, four-year
    groups, years and months.
    """
    n = F.date_diff(day, F.lit("1600-01-01").cast("date")).cast("long") - _SHIFT
    in_cycle = F.pmod(n, F.lit(_CYCLE))
    in_four = in_cycle % _FOUR
    # the first year of a four-year group has 366 days
    later = F.when(in_four >= 366, _div(in_four - 1, 365)).otherwise(0)
    of_year = F.when(in_four >= 366, (in_four - 1) % 365).otherwise(in_four)
    year = 979 + 33 * _div(n, _CYCLE) + 4 * _div(in_cycle, _FOUR) + later
    month = F.when(of_year < 186, 1 + _div(of_year, 31)).otherwise(7 + _div(of_year - 186, 30))
    date = F.when(of_year < 186, 1 + of_year % 31).otherwise(1 + (of_year - 186) % 30)
    return F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), date.cast("int").alias("day"))


def from_jalali(year: Column, month: Column, day: Column) -> Column:
    """The date of a Jalali year, month and day."""
    y = year.cast("long") + 1595
    months = F.when(month < 7, (month - 1) * 31).otherwise((month - 7) * 30 + 186)
    n = 365 * y + _div(y, 33) * 8 + _div(F.pmod(y, F.lit(33)) + 3, 4) + day + months - 355668
    # day number n counts from the (proleptic) start of year 0; 1600-01-01 is its day 584388
    return F.date_add(F.lit("1600-01-01").cast("date"), (n - 584388).cast("int"))


def is_leap_gregorian(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def is_leap_jalali(year: Column) -> Column:
    """Leap years by the table of breaks of the 33-year cycle."""
    out = F.lit(None).cast("boolean")
    for at, (start, end) in reversed(list(enumerate(zip(BREAKS, BREAKS[1:], strict=False)))):
        jump, n = end - start, year - start
        adjusted = F.when(jump - n < 6, n - jump + (jump + 4) // 33 * 33).otherwise(n)
        rest = F.pmod(adjusted + 1, F.lit(33)) - 1
        leap = (rest % 4) == 0
        out = F.when(year < end, leap).otherwise(out) if at else F.when(year < start, F.lit(None)).when(year < end, leap).otherwise(out)
    return out


def days_in_month(calendar: str, year: Column, month: Column) -> Column:
    if calendar == "jalali":
        return F.when(month <= 6, 31).when(month <= 11, 30).when(is_leap_jalali(year), 30).otherwise(29)
    return F.day(F.last_day(F.make_date(year, month, F.lit(1))))


def parts(calendar: str, day: Column) -> Column:
    """struct<year, month, day> in either calendar."""
    if calendar == "jalali":
        return to_jalali(day)
    return F.struct(F.year(day).alias("year"), F.month(day).alias("month"), F.day(day).alias("day"))


def date_of(calendar: str, year: Column, month: Column, day: Column) -> Column:
    return from_jalali(year, month, day) if calendar == "jalali" else F.make_date(year, month, day)


def _name(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), index)


def month_name(calendar: str, month: Column, persian: bool = False) -> Column:
    names = GREGORIAN_MONTHS if calendar == "gregorian" else JALALI_MONTHS_FA if persian else JALALI_MONTHS
    return _name(names, month.cast("int"))


def weekday_name(calendar: str, day: Column, persian: bool = False) -> Column:
    monday_first = F.weekday(day)
    if calendar == "gregorian":
        return _name(GREGORIAN_WEEKDAYS, monday_first + 1)
    return _name(JALALI_WEEKDAYS_FA if persian else JALALI_WEEKDAYS, (monday_first + 2) % 7 + 1)


def parse_month(text: str, calendar: str = "gregorian") -> int:
    """A month from its number, name or three-letter form."""
    value = text.strip().lower()
    if value.isdigit() and 1 <= int(value) <= 12:
        return int(value)
    names = JALALI_MONTHS if calendar == "jalali" else GREGORIAN_MONTHS
    for k, name in enumerate(names, 1):
        if value in (name.lower(), name.lower()[:3]):
            return k
    raise DataError(f"Unknown month: {text!r}.")


def parse_date(text: Column) -> Column:
    """A Gregorian date in one of the usual orders; null if it is none."""
    value = F.trim(text)
    forms = {
        r"^\d{8}$": "yyyyMMdd", r"^\d{4}-\d{1,2}-\d{1,2}$": "yyyy-M-d", r"^\d{4}/\d{1,2}/\d{1,2}$": "yyyy/M/d", r"^\d{1,2}-\d{1,2}-\d{4}$": "d-M-yyyy",
        r"^[A-Z][a-z]{2} \d{1,2},? \d{4}$": "MMM d yyyy", r"^[A-Z][a-z]{3,} \d{1,2},? \d{4}$": "MMMM d yyyy", r"^\d{1,2} [A-Z][a-z]{2} \d{4}$": "d MMM yyyy", r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$": "d MMMM yyyy",
    }
    tries = [F.when(value.rlike(shape), F.try_to_timestamp(F.replace(value, F.lit(","), F.lit("")), F.lit(form)).cast("date")) for shape, form in forms.items()]
    return F.coalesce(*tries)


def parse_jalali(text: Column) -> Column:
    """The date of a Jalali Y-m-d or Y/m/d; null if there is no such day."""
    part = lambda k: F.regexp_extract(text, r"^\s*(\d{1,4})[-/](\d{1,2})[-/](\d{1,2})\s*$", k).try_cast("int")
    y, m, d = part(1), part(2), part(3)
    good = m.between(1, 12) & (d >= 1) & (d <= days_in_month("jalali", y, m))
    return F.when(good, from_jalali(y, m, d))


def parse_epoch(text: Column) -> Column:
    """A timestamp from epoch seconds: an integer of ten digits or more, or a decimal."""
    good = text.rlike(r"^\s*-?(?:\d{10,}|\d+\.\d+)\s*$")
    return F.when(good, F.timestamp_micros((F.trim(text).try_cast("decimal(30,6)") * 1000000).try_cast("long")))


def parse_datetime(text: Column) -> Column:
    """A timestamp from date, optional time and optional zone offset (Z, +HH, +HHMM, +HH:MM)."""
    shape = r"^\s*(\S+?)(?:[T ](\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)\s*(Z|[+-]\d{2}(?::?\d{2})?)?)?\s*$"
    day, time, zone = (F.regexp_extract(text, shape, k) for k in (1, 2, 3))
    hms = F.split(time, ":")
    seconds = F.when(time == "", 0).otherwise(F.element_at(hms, 1).try_cast("int") * 3600 + F.try_element_at(hms, F.lit(2)).try_cast("int") * 60 + F.coalesce(F.try_element_at(hms, F.lit(3)).try_cast("decimal(9,6)"), F.lit(0)))
    digits = F.rpad(F.regexp_replace(zone, "[^0-9]", ""), 4, "0")
    shift = F.when(zone.isin("", "Z"), 0).otherwise((F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")) * 60 * F.when(zone.startswith("-"), -1).otherwise(1))
    micros = F.unix_micros(parse_date(day).cast("timestamp")) + ((seconds - shift) * 1000000).cast("long")
    return F.timestamp_micros(micros)


def bounds(calendar: str, day: Column, unit: str) -> tuple[Column, Column]:
    """First and last moment (23:59:59) of the year, month or day that holds a date."""
    p = parts(calendar, day)
    one = F.lit(1)
    if unit == "year":
        first, after = date_of(calendar, p["year"], one, one), date_of(calendar, p["year"] + 1, one, one)
    elif unit == "month":
        first = date_of(calendar, p["year"], p["month"], one)
        after = F.when(p["month"] == 12, date_of(calendar, p["year"] + 1, one, one)).otherwise(date_of(calendar, p["year"], F.least(p["month"] + 1, F.lit(12)), one))
    elif unit == "day":
        first, after = day.cast("date"), F.date_add(day, 1)
    else:
        raise DataError(f"Unknown unit {unit!r}: year, month or day.")
    return first.cast("timestamp"), after.cast("timestamp") - F.expr("INTERVAL 1 SECOND")


def difference(calendar: str, start: Column, end: Column) -> Column:
    """struct<years, months, days, hours, minutes, seconds> between two timestamps, whichever is first.

    Borrows from right to left: a day for the time of day, the length of the
    month before the end's for the day, a year for the month.
    """
    a, b = F.date_trunc("second", F.least(start, end)), F.date_trunc("second", F.greatest(start, end))
    clock = lambda t: F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    gap = clock(b) - clock(a)
    last = F.when(gap < 0, F.date_sub(b.cast("date"), 1)).otherwise(b.cast("date"))
    gap = F.when(gap < 0, gap + 86400).otherwise(gap)
    p, q = parts(calendar, a.cast("date")), parts(calendar, last)
    borrow = q["day"] < p["day"]
    y = F.when(borrow & (q["month"] == 1), q["year"] - 1).otherwise(q["year"])
    m = F.when(borrow, F.when(q["month"] == 1, 12).otherwise(q["month"] - 1)).otherwise(q["month"])
    d = F.when(borrow, q["day"] + days_in_month(calendar, y, m)).otherwise(q["day"])
    wrap = m < p["month"]
    return F.struct(
        (F.when(wrap, y - 1).otherwise(y) - p["year"]).cast("int").alias("years"), (F.when(wrap, m + 12).otherwise(m) - p["month"]).cast("int").alias("months"), (d - p["day"]).cast("int").alias("days"),
        F.floor(gap / 3600).cast("int").alias("hours"), F.floor(gap % 3600 / 60).cast("int").alias("minutes"), (gap % 60).cast("int").alias("seconds"),
    )


def distance(start: Column, end: Column) -> Column:
    """struct<days, hours, seconds> in total between two timestamps, whichever is first."""
    seconds = F.abs(F.unix_micros(end) - F.unix_micros(start)) / 1000000
    return F.struct((seconds / 86400).alias("days"), (seconds / 3600).alias("hours"), seconds.alias("seconds"))


def format_datetime(calendar: str, at: Column, persian: bool = False, weekday: bool = True) -> Column:
    """``YYYY-MM-DD HH:MM:SS (Month, Weekday)``; fractions of a second only where there are any."""
    p, day = parts(calendar, at.cast("date")), at.cast("date")
    micros = F.pmod(F.unix_micros(at), F.lit(1000000))
    fraction = F.when(micros > 0, F.format_string(".%06d", micros)).otherwise("")
    names = month_name(calendar, p["month"], persian)
    if weekday:
        names = F.concat(names, F.lit(", "), weekday_name(calendar, day, persian))
    return F.concat(F.format_string("%04d-%02d-%02d ", p["year"], p["month"], p["day"]), F.date_format(at, "HH:mm:ss"), fraction, F.lit(" ("), names, F.lit(")"))


def payload(at: Column) -> Column:
    """A moment in both calendars, as epoch seconds and in ISO form."""
    return F.struct(format_datetime("gregorian", at).alias("gregorian"), format_datetime("jalali", at).alias("jalali"), (F.unix_micros(at) / 1000000).alias("unix"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("iso"))


def nearer_calendar(gregorian: Column, jalali: Column, now: Column) -> Column:
    """Of two readings of a date the Jalali one if it lies within a year of ``now``, else the nearer one."""
    far = lambda d: F.abs(F.date_diff(d, now))
    return F.when(far(jalali) <= 365, jalali).when(gregorian.isNull() | (far(jalali) < far(gregorian)), jalali).otherwise(gregorian)
