"""Path patterns, suffixes, process tables and relational layout statistics."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loamgrid.errors import DataError
from loamgrid.functions import paths
from loamgrid.operators import processes
from loamgrid.sources import pdf


def test_braces():
    assert paths.expand_braces("a{b,c{d,e}}f") == ["abf", "acdf", "acef"]
    assert paths.expand_braces("{x}") == ["{x}"] and paths.expand_braces("a{b") == ["a{b"] and paths.expand_braces("{,.bak}") == ["", ".bak"]
    assert paths.looks_like_regex(r".*\.txt$") and not paths.looks_like_regex("*.txt")


def test_globs(spark):
    names = spark.createDataFrame([("a.txt",), ("b.md",), ("a+b.txt",), ("x/a.txt",)], "n string")
    assert sorted(r.n for r in names.filter(F.col("n").rlike(paths.glob_to_regex("*.{txt,rst}"))).collect()) == ["a+b.txt", "a.txt"]


def test_suffixes(spark):
    rows = spark.createDataFrame([(1, "a.tar.gz"), (2, "a.tar.gz"), (3, "a.tar.gz"), (4, "b")], "k int, p string")
    assert [r.unique_path for r in paths.unique_paths(rows, "p", [F.col("k")]).orderBy("k").collect()] == ["a.tar.gz", "a.tar(1).gz", "a.tar(2).gz", "b"]
    assert [r.unique_name for r in paths.with_suffixes(rows, "p", [F.col("k")]).orderBy("k").collect()] == ["a.tar.gz", "a.tar.gz_2", "a.tar.gz_3", "b"]
    assert spark.range(1).select(paths.part_name("out", F.lit(7), 120).alias("n")).first().n == "out-007"


def test_processes(spark):
    rows = spark.createDataFrame([(1, "root", "init", "/sbin/init", 0.5, 10), (2, "ann", "Python", "python x.py" + "y" * 200, 9.0, 30), (3, "ann", "sh", "sh -c python", 9.0, 20), (4, "bob", "cat", None, 1.0, 5)], "pid int, user string, name string, cmdline string, cpu_percent double, rss long")
    pids = lambda frame: [r.pid for r in frame.collect()]
    assert pids(processes.top(rows)) == [2, 3, 4, 1] and pids(processes.top(rows, "pid", 2)) == [1, 2] and pids(processes.top(rows, "rss", 0, "ann")) == [2, 3]
    assert pids(processes.matching(rows, "PYTHON")) == [2] and pids(processes.matching(rows, "python", whole_command=True)) == [2, 3] and pids(processes.matching(rows, "pyth", exact=True)) == []
    assert max(len(r.cmdline or "") for r in processes.shown(rows).collect()) == 100
    with pytest.raises(DataError):
        processes.top(rows, "size")
    one = spark.range(1).select(processes.memory_used(*(F.lit(v) for v in (100, 30, 10, 20, 5))).alias("u"), processes.memory_used(*(F.lit(v) for v in (10, 30, 10, 20, 5))).alias("z"), processes.cpu_percent(F.lit(5), F.lit(20)).alias("c"), processes.cpu_percent(F.lit(5), F.lit(0)).alias("n")).first()
    assert tuple(one) == (35, 0, 25.0, None)
    pings = spark.createDataFrame([("h", 1.0), ("h", None), ("h", 3.0)], "host string, ms double")
    row = processes.latency(pings, "ms", ["host"]).first()
    assert (row.sent, row.received, round(row.loss, 3), row.low, row.mean, row.high) == (3, 2, 33.333, 1.0, 2.0, 3.0)
    ports = spark.createDataFrame([("h", 443, True), ("h", 80, True), ("h", 22, False)], "host string, port int, open boolean")
    assert [r.port for r in processes.open_ports(ports).collect()] == [80, 443]
    lines = spark.createDataFrame([("MemTotal:  16 kB",), ("odd",), ("a:b:c",)], "value string")
    assert sorted(map(tuple, processes.key_values(lines).collect())) == [("MemTotal", "16 kB"), ("a", "b:c")]


def test_layout_statistics(spark):
    lines = spark.createDataFrame([("d", 0, k, 700.0 - 12 * k, s, "t") for k, s in enumerate((20.0, 10.0, 10.0, 10.0, 14.0, 14.0, 14.0))] + [("e", 0, 0, 1.0, 9.0, "x")], "doc string, page int, place int, y double, size double, text string")
    assert {r.doc: r.body for r in pdf.modal_size(lines).collect()} == {"d": 10.0, "e": 9.0}
    assert {r.doc: r.leading for r in pdf.median_leading(lines).collect()} == {"d": 12.0, "e": 12.0}
    assert sorted((r.doc, r.size, r.level) for r in pdf.heading_sizes(lines).collect()) == [("d", 14.0, 2), ("d", 20.0, 1)]
