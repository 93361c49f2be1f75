"""Process, port and latency tables: the data part of host commands, over rows from anywhere.

A process table has pid, user, name, cmdline, cpu_percent, mem_percent, rss, vms, threads and elapsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.errors import DataError

SORTS = {"cpu": "cpu_percent", "mem": "mem_percent", "rss": "rss", "threads": "threads", "time": "elapsed", "pid": "pid"}
#: Columns of the process rows that a command line is shown in.
CLIP = 100


def top(processes: DataFrame, sort: str = "cpu", limit: int = 20, user: str | None = None) -> DataFrame:
    """The first rows by a key, falling except for the pid; 0 keeps all."""
    if sort not in SORTS:
        raise DataError(f"Unknown sort {sort!r}. Known: {', '.join(SORTS)}.")
    rows = processes if user is None else processes.filter(F.col("user") == user)
    key = F.col(SORTS[sort])
    ordered = rows.orderBy(key if sort == "pid" else key.desc(), "pid")
    return ordered.limit(limit) if limit else ordered


def matching(processes: DataFrame, text: str, exact: bool = False, whole_command: bool = False) -> DataFrame:
    """Processes whose name, or also command line, is or contains a text, case aside; largest first."""
    want = F.lower(F.lit(text))
    test = (lambda c: F.lower(c) == want) if exact else (lambda c: F.contains(F.lower(c), want))
    hit = test(F.col("name"))
    if whole_command:
        hit = hit | F.coalesce(test(F.col("cmdline")), F.lit(False))
    return processes.filter(hit).orderBy(F.desc("rss"), "pid")


def shown(processes: DataFrame) -> DataFrame:
    return processes.withColumn("cmdline", F.left("cmdline", F.lit(CLIP)))


def memory_used(total: Column, free: Column, buffers: Column, cached: Column, reclaimable: Column) -> Column:
    return F.greatest(total - free - buffers - (cached + reclaimable), F.lit(0))


def cpu_percent(cpu_seconds: Column, elapsed_seconds: Column) -> Column:
    """Null where no time has passed."""
    return F.try_divide(100 * cpu_seconds, F.when(elapsed_seconds > 0, elapsed_seconds))


def open_ports(results: DataFrame, only_open: bool = True) -> DataFrame:
    """Probe results (host, port, open, latency) by port."""
    return (results.filter("open") if only_open else results).orderBy("host", "port")


def latency(results: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Sent, received, loss in percent and the extremes and mean of what came back, by group."""
    loss = 100 * (F.count("*") - F.count(value)) / F.count("*")
    return results.groupBy(*by).agg(F.count("*").alias("sent"), F.count(value).alias("received"), loss.alias("loss"), F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"))


def key_values(lines: DataFrame, line: str = "value", separator: str = ":") -> DataFrame:
    """(key, value) of lines such as ``MemTotal:  16 kB``; lines without a separator are left out."""
    at = F.instr(line, separator)
    return lines.filter(at > 0).select(F.trim(F.substring_index(line, separator, 1)).alias("key"), F.trim(F.regexp_replace(F.col(line), f"^[^{separator}]*{separator}", "")).alias("value"))
