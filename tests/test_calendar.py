"""Calendars, intervals and expressions."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from loamgrid.errors import DataError
from loamgrid.functions import calendar, expression, intervals

KNOWN = {"2024-03-20": (1403, 1, 1), "2021-03-20": (1399, 12, 30), "2026-04-24": (1405, 2, 4), "1979-02-11": (1357, 11, 22), "2000-01-01": (1378, 10, 11), "2025-03-20": (1403, 12, 30)}


def one(spark, expression_, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), expression_.alias("out")).first().out if values else spark.range(1).select(expression_.alias("out")).first().out


def test_known_dates(spark):
    frame = spark.createDataFrame([(k,) for k in KNOWN], "d string").select("d", calendar.to_jalali(F.col("d").cast("date")).alias("j"))
    for r in frame.collect():
        assert tuple(r.j) == KNOWN[r.d]


def test_round_trip(spark):
    days = spark.range(60000).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    j = calendar.to_jalali(F.col("d"))
    bad = days.filter(calendar.from_jalali(j["year"], j["month"], j["day"]) != F.col("d")).count()
    assert bad == 0


def test_leap_years(spark):
    years = spark.range(1350, 1420).select(F.col("id").cast("int").alias("y"), calendar.is_leap_jalali(F.col("id").cast("int")).alias("leap"))
    assert [r.y for r in years.filter("leap").collect()] == [1350, 1354, 1358, 1362, 1366, 1370, 1375, 1379, 1383, 1387, 1391, 1395, 1399, 1403, 1408, 1412, 1416]
    assert [one(spark, calendar.is_leap_gregorian(F.lit(y))) for y in (1900, 2000, 2023, 2024)] == [False, True, False, True]


def test_names_and_months(spark):
    day = F.lit("2024-03-20").cast("date")
    assert one(spark, calendar.weekday_name("jalali", day)) == "Chaharshanbeh" and one(spark, calendar.weekday_name("gregorian", day)) == "Wednesday"
    assert one(spark, calendar.month_name("jalali", F.lit(1), persian=True)) == "فروردین"
    assert [calendar.parse_month(*a) for a in (("3",), ("MAR",), ("march",), ("esf", "jalali"))] == [3, 3, 3, 12]
    with pytest.raises(DataError):
        calendar.parse_month("foo")
    lengths = [one(spark, calendar.days_in_month(*(c, F.lit(y), F.lit(m)))) for c, y, m in (("jalali", 1403, 12), ("jalali", 1402, 12), ("jalali", 1402, 6), ("gregorian", 2024, 2))]
    assert lengths == [30, 29, 31, 29]


def test_bounds(spark):
    first, last = calendar.bounds("jalali", F.lit("2024-03-25").cast("date"), "month")
    assert (one(spark, first), one(spark, last)) == (dt.datetime(2024, 3, 20), dt.datetime(2024, 4, 19, 23, 59, 59))
    first, last = calendar.bounds("jalali", F.lit("2024-03-19").cast("date"), "month")
    assert (one(spark, first), one(spark, last)) == (dt.datetime(2024, 2, 20), dt.datetime(2024, 3, 19, 23, 59, 59))
    first, last = calendar.bounds("gregorian", F.lit("2024-12-31").cast("date"), "year")
    assert (one(spark, first), one(spark, last)) == (dt.datetime(2024, 1, 1), dt.datetime(2024, 12, 31, 23, 59, 59))


def test_difference(spark):
    gap = lambda kind, a, b: tuple(one(spark, calendar.difference(kind, F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp"))))
    assert gap("gregorian", "2024-01-31 10:00:00", "2024-03-01 09:00:00") == (0, 0, 29, 23, 0, 0)
    assert gap("gregorian", "2024-03-01 09:00:00", "2023-01-15 08:30:10") == (1, 1, 15, 0, 29, 50)
    assert gap("jalali", "2024-03-20 00:00:00", "2025-03-21 00:00:00") == (1, 0, 0, 0, 0, 0)


def test_parsing(spark):
    dates = {"20240320": "2024-03-20", "2024-3-5": "2024-03-05", "2024/03/20": "2024-03-20", "20-03-2024": "2024-03-20", "Mar 20, 2024": "2024-03-20", "20 March 2024": "2024-03-20", "2024-02-30": None, "x": None}
    for source, want in dates.items():
        assert str(one(spark, calendar.parse_date(F.lit(source)))) == str(want), source
    assert str(one(spark, calendar.parse_jalali(F.lit("1403/01/01")))) == "2024-03-20" and one(spark, calendar.parse_jalali(F.lit("1402-12-30"))) is None
    stamps = {"2024-03-20T10:20:30.5+03:30": dt.datetime(2024, 3, 20, 6, 50, 30, 500000), "2024-03-20 10:20Z": dt.datetime(2024, 3, 20, 10, 20), "2024-03-20 10:20:30-0500": dt.datetime(2024, 3, 20, 15, 20, 30), "2024-03-20": dt.datetime(2024, 3, 20)}
    for source, want in stamps.items():
        assert one(spark, calendar.parse_datetime(F.lit(source))) == want, source
    assert one(spark, calendar.parse_epoch(F.lit("1700000000"))) == dt.datetime(2023, 11, 14, 22, 13, 20) and one(spark, calendar.parse_epoch(F.lit("123"))) is None


def test_formats(spark):
    at = F.lit("2024-03-20 01:02:03").cast("timestamp")
    assert one(spark, calendar.format_datetime("gregorian", at)) == "2024-03-20 01:02:03 (March, Wednesday)"
    assert one(spark, calendar.payload(at)).jalali == "1403-01-01 01:02:03 (Farvardin, Chaharshanbeh)"
    spent = [one(spark, intervals.format_duration(F.lit(float(s)))) for s in (0, 59, 3661, -90061.4)]
    assert spent == ["0s", "59s", "1h 1m 1s", "-1d 1h 1m 1s"]
    assert [one(spark, intervals.format_hours_minutes(F.lit(h))) for h in (3.0, 1.5, -0.25)] == ["03:00", "01:30", "-00:15"]
    assert [one(spark, intervals.format_total(F.lit(v))) for v in (3.0, 2.5, 100.0, 0.1234567)] == ["3", "2.5", "100", "0.123457"]


GOOD = {"2 days": (0, 2, 0), "-3.4 hours": (0, 0, -12240), "1 y 2 mon": (14, 0, 0), "1 day 02:30": (0, 1, 9000), "1w, 5m": (0, 7, 300), "-01:00:30.5": (0, 0, -3630.5), "3MO": (3, 0, 0), "1 mon -2 d": (1, -2, 0), "10s": (0, 0, 10)}


def test_intervals(spark):
    for source, (months, days, seconds) in GOOD.items():
        got = intervals.parse_interval(source)
        assert (got.months, got.days) == (months, days) and got.seconds == pytest.approx(seconds), source
        m, s = intervals.interval_columns(F.lit(source))
        assert (one(spark, m), one(spark, s)) == (months, pytest.approx(days * 86400 + seconds)), source
    for source in ("", "banana", "3 fortnights", "1.5 years", "2 days x"):
        with pytest.raises(DataError):
            intervals.parse_interval(source)
        assert one(spark, intervals.interval_columns(F.lit(source))[0]) is None, source
    jan = F.lit("2024-01-31 12:00:00").cast("timestamp")
    assert one(spark, intervals.apply_interval(jan, intervals.parse_interval("1 mon 1.5 d"))) == dt.datetime(2024, 3, 2, 0, 0)
    assert one(spark, intervals.apply_interval(jan, intervals.parse_interval("2 mon"), -1)) == dt.datetime(2023, 11, 30, 12, 0)


EXPRESSIONS = {
    "1 + 2 * 3": 7, "2 ^ 10": 1024, "-7 // 2": -4, "-7 % 3": 2, "7 % -3": -2, "7 / 2": 3.5, "1 < 2 < 3": True, "1 < 3 < 2": False, "~5": -6, "5 & 3 | 8": 9, "1 << 4 >> 2": 4, "sqrt(16) + cbrt(27)": 7, "round(2.5)": 2, "round(3.14159, 2)": 3.14, "min(3, 1, 2) + max(1, 5)": 6,
    "gcd(84, 36)": 12, "lcm(4, 6)": 12, "factorial(5)": 120, "comb(5, 2)": 10, "perm(5, 2)": 20, "hypot(3, 4)": 5, "degrees(pi)": 180, "log(8, 2)": 3, "ln(e)": 1, "copysign(3, -1)": -3, "atan2(1, 1) * 4": math.pi, "trunc(-2.7)": -2, "xor(6, 3)": 5, "int(3.9)": 3, "abs(-2)": 2, "tau / pi": 2,
}


def test_expressions(spark):
    row = spark.range(1).select(*(expression.compile_expression(e).alias(f"c{k}") for k, e in enumerate(EXPRESSIONS))).first()
    for got, (source, want) in zip(row, EXPRESSIONS.items(), strict=True):
        assert got == pytest.approx(want), source
    assert one(spark, expression.compile_expression("6 ^ 3", caret="xor")) == 5
    assert one(spark, expression.compile_expression("1 / 0", null_on_zero=True)) is None
    for bad in ("1 +", "foo(1)", "x + 1", "'a'", "(1).real", "a and b", "factorial(99999)", "sqrt(1, 2)", "sqrt(x=1)", "True"):
        with pytest.raises(DataError):
            expression.compile_expression(bad)
    with pytest.raises(DataError, match="sqrt"):
        expression.compile_expression("sqr(4)")
    shown = [one(spark, expression.format_result(F.lit(v), b)) for v, b in ((255, "hex"), (5, "bin"), (8, "oct"), (3.0, "dec"), (1 / 3, "dec"), (0.1 + 0.2, "dec"))]
    assert shown == ["0xff", "0b101", "0o10", "3", "0.333333333333", "0.3"]


def test_whole_number_functions_are_exact_and_short(spark):
    fibonacci = [1, 2]
    while fibonacci[-1] + fibonacci[-2] < 1 << 63:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    pairs = [*zip(fibonacci, fibonacci[1:], strict=False), *zip(fibonacci[1:], fibonacci, strict=False), (0, 0), (0, 7), (7, 0), (-4, 6), (2**63 - 1, 2**62), (10**9 + 7, 10**9 + 9), (6 * 10**9, 4 * 10**9)]
    run = lambda e: expression.compile_expression(e, {c: F.col(c) for c in "ab"})
    frame = spark.createDataFrame([*pairs, (None, 6), (6, None)], "a long, b long")
    assert [r[0] for r in frame.select(run("gcd(a, b)")).collect()] == [*(math.gcd(*p) for p in pairs), None, None]
    small = [p for p in pairs if math.lcm(*p) < 1 << 63]
    assert (10**9 + 7, 10**9 + 9) in small and (6 * 10**9, 4 * 10**9) in small
    assert [r[0] for r in spark.createDataFrame(small, "a long, b long").select(run("lcm(a, b)")).collect()] == [math.lcm(*p) for p in small]
    few = [(a, b) for a in range(24) for b in range(25)]
    rows = spark.createDataFrame(few, "a long, b long").select("a", "b", run("factorial(a)"), run("comb(a, b)"), run("perm(a, b)")).collect()
    assert len(rows) == len(few) and all(list(r)[2:] == [pytest.approx(v, rel=1e-15) for v in (math.factorial(r.a), math.comb(r.a, r.b), math.perm(r.a, r.b))] for r in rows)
    assert frame.filter("a is null").select(run("factorial(a)")).first()[0] is None
    plan = frame.select(run("lcm(a, b)").alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
