"""Time entries: filters, reports and listings over intervals.

An entry has id, project (may be null), task, start_ts and end_ts (null while it
runs).  ``now`` is always given, so that results can be repeated.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgrid.errors import DataError
from loamgrid.functions import calendar, intervals
from loamgrid.functions.text import java_quote

FIELDS = ("project", "task", "year", "month", "day")


def with_hours(entries: DataFrame, now: Column) -> DataFrame:
    """Adds ``hours``; an open entry ends at ``now``."""
    return entries.withColumn("hours", (F.unix_micros(F.coalesce("end_ts", now)) - F.unix_micros("start_ts")) / 3.6e9)


def filtered(
    entries: DataFrame, ids: Iterable[int] = (), project: str | None = None, task: str | None = None, project_regex: str | None = None, task_regex: str | None = None,
    start: Column | None = None, end: Column | None = None, within: intervals.Interval | None = None, now: Column | None = None, running: bool | None = None,
) -> DataFrame:
    """Entries that pass every filter given.

    Literal filters are substrings and fold A-Z alone; a regular expression is
    searched for, and a null matches none; times are inclusive.
    """
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if ids := list(ids):
        entries = entries.filter(F.col("id").isin(ids))
    for name, part in (("project", project), ("task", task)):
        if part is not None:
            entries = entries.filter(F.contains(fold(F.col(name)), fold(F.lit(part))))
    for name, pattern in (("project", project_regex), ("task", task_regex)):
        if pattern is not None:
            entries = entries.filter(F.coalesce(F.col(name).rlike(pattern), F.lit(False)))
    if within is not None:
        if now is None:
            raise DataError("A relative window needs now.")
        entries = entries.filter(F.col("start_ts").between(intervals.apply_interval(now, within, -1), now))
    if start is not None:
        entries = entries.filter(F.col("start_ts") >= start)
    if end is not None:
        entries = entries.filter(F.col("start_ts") <= end)
    if running is not None:
        entries = entries.filter(F.col("end_ts").isNull() if running else F.col("end_ts").isNotNull())
    return entries


def group_fields(names: Iterable[str]) -> list[str]:
    """Comma lists of fields in their fixed order; a month needs its year and a day its month."""
    wanted = {part.strip().lower() for name in names for part in name.split(",") if part.strip()}
    if unknown := wanted - set(FIELDS):
        raise DataError(f"Unknown group field(s): {', '.join(sorted(unknown))}.")
    if wanted & {"month", "day"} and "year" not in wanted:
        raise DataError("Grouping by month or day needs year.")
    if "day" in wanted and "month" not in wanted:
        raise DataError("Grouping by day needs month.")
    return [f for f in FIELDS if f in wanted]


def report(entries: DataFrame, group_by: Iterable[str], now: Column, kind: str = "gregorian") -> DataFrame:
    """Hours and entries of each group, groups in the order of their first start."""
    fields = group_fields(group_by)
    rows = with_hours(entries, now)
    part = calendar.parts(kind, F.col("start_ts").cast("date"))
    for f in fields:
        if f in ("year", "month", "day"):
            rows = rows.withColumn(f, part[f])
    out = rows.groupBy(*fields).agg(F.sum("hours").alias("hours"), F.count("*").alias("entries"), F.min("start_ts").alias("first_start"))
    return out.orderBy("first_start", *fields)


def period_start(kind: str, fields: list[str]) -> Column:
    """Midnight at which a group's year, month or day begins, in columns of that name."""
    one = F.lit(1)
    pick = lambda f: F.col(f) if f in fields else one
    return calendar.date_of(kind, pick("year"), pick("month"), pick("day")).cast("timestamp")


def dimension(entries: DataFrame, name: str, now: Column) -> DataFrame:
    """Entries, hours and latest start of each project or task, most hours first."""
    if name not in ("project", "task"):
        raise DataError("A listing is by project or task.")
    out = with_hours(entries, now).groupBy(F.coalesce(name, F.lit("(none)")).alias(name)).agg(F.count("*").alias("entries"), F.sum("hours").alias("hours"), F.max("start_ts").alias("last_start"))
    return out.orderBy(F.desc("hours"), name)


def total(entries: DataFrame, now: Column) -> DataFrame:
    """One row: hours, HH:MM and number of entries."""
    one = with_hours(entries, now).agg(F.coalesce(F.sum("hours"), F.lit(0.0)).alias("hours"), F.count("*").alias("entries"))
    return one.withColumn("clock", intervals.format_hours_minutes(F.col("hours")))


def latest(entries: DataFrame) -> DataFrame:
    """The entry that started last."""
    return entries.orderBy(F.desc("start_ts"), F.desc("id")).limit(1)


def implied_ends(entries: DataFrame, by: str | None = None) -> DataFrame:
    """Entries in which an open one ends where the next begins, as starting a task closes the running one."""
    window = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy("start_ts", "id")
    return entries.withColumn("end_ts", F.coalesce("end_ts", F.lead("start_ts").over(window)))


def started(entries: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """All running entries closed at ``now`` and the new ones added."""
    return entries.withColumn("end_ts", F.coalesce("end_ts", now)).unionByName(new)


def ended(entries: DataFrame, now: Column) -> DataFrame:
    return entries.withColumn("end_ts", F.coalesce("end_ts", now))


def edited(entries: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Entries with new values where ``condition`` holds; an end before its start is an error at run time."""
    out = entries
    for name, value in values.items():
        out = out.withColumn(name, F.when(condition, value).otherwise(F.col(name)))
    bad = F.col("end_ts") < F.col("start_ts")
    return out.withColumn("end_ts", F.when(bad, F.raise_error(F.lit("An entry ends before it starts."))).otherwise(F.col("end_ts")))


def deleted(entries: DataFrame, condition: Column) -> DataFrame:
    return entries.filter(~F.coalesce(condition, F.lit(False)))


def long_running(entries: DataFrame, now: Column, hours: float = 5.0) -> DataFrame:
    return with_hours(entries, now).filter(F.col("hours") > hours)


def literal_pattern(text: str) -> str:
    """A literal as a regular expression."""
    return java_quote(text)
