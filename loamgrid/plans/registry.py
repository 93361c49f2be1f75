"""The registered queries over the standard tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions import calendar, expression, intervals, lattice, paths, text, urls
from loamgrid.operators import files, processes, profile, sql_sink, structure, time_entries
from loamgrid.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- profiles ---------------------------------------------------------------------------------------------------------

_LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _profile_sql(name: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS field, CAST(count({c}) AS BIGINT) AS non_null, CAST(count(*) - count({c}) AS BIGINT) AS nulls, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count FROM {name}" for c in columns)


def _profile(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return profile.distinct_and_top(table(spark, sf_dir, name)).select("field", "non_null", "nulls", F.col("distinct").alias("distinct_count"))


@query(_profile_sql("lineitem", _LINEITEM))
def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, "lineitem")


@query(_profile_sql("orders", _ORDERS))
def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, "orders")


@query(_profile_sql("customer", _CUSTOMER))
def profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, "customer")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, round(CAST(min({c}) AS DOUBLE), 4) AS low, round(CAST(max({c}) AS DOUBLE), 4) AS high, round(avg({c}), 4) AS mean FROM lineitem" for c in _LINEITEM[:8]))
def profile_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.extremes(table(spark, sf_dir, "lineitem"), _LINEITEM[:8])
    return out.select("field", F.round(F.col("low").cast("double"), 4).alias("low"), F.round(F.col("high").cast("double"), 4).alias("high"), F.round("mean", 4).alias("mean"))


@query("SELECT CAST(min(length(text)) AS BIGINT) AS low, CAST(max(length(text)) AS BIGINT) AS high, round(avg(length(text)), 4) AS mean FROM documents")
def profile_text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.extremes(table(spark, sf_dir, "documents"), ["text"])
    return out.select(F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.round("mean", 4).alias("mean"))


def _top_sql(name: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"(SELECT '{c}' AS field, {c} AS top, CAST(count(*) AS BIGINT) AS top_count FROM {name} GROUP BY {c} HAVING count(*) > 1 ORDER BY count(*) DESC, {c} LIMIT 1)" for c in columns)


@query(_top_sql("part", ("p_brand", "p_type")) + " UNION ALL " + _top_sql("customer", ("c_mktsegment",)))
def profile_top_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = profile.distinct_and_top(table(spark, sf_dir, "part"), ["p_brand", "p_type"])
    return part.unionByName(profile.distinct_and_top(table(spark, sf_dir, "customer"), ["c_mktsegment"])).select("field", "top", "top_count")


@query("SELECT CAST(count(*) FILTER (quality = 1) AS BIGINT) AS trues, CAST(count(*) FILTER (quality <> 1) AS BIGINT) AS falses FROM labels")
def bool_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("good"))
    return profile.extremes(good).select("trues", "falses")


@query("SELECT CAST(min(len(embedding)) AS BIGINT) AS low, CAST(max(len(embedding)) AS BIGINT) AS high, round(avg(len(embedding)), 4) AS mean FROM embeddings")
def container_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.extremes(table(spark, sf_dir, "embeddings"), ["embedding"])
    return out.select(F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.round("mean", 4).alias("mean"))


@query(
    """WITH s AS (SELECT c_nationkey + 1 AS keyed, CASE WHEN c_nationkey = 0 THEN 1 ELSE 2 END AS fields, len(string_split(c_name, '0')) AS parsed FROM customer)
    SELECT 'keyed' AS field, CAST(min(keyed) AS BIGINT) AS low, CAST(max(keyed) AS BIGINT) AS high, round(avg(keyed), 4) AS mean FROM s
    UNION ALL SELECT 'fields', CAST(min(fields) AS BIGINT), CAST(max(fields) AS BIGINT), round(avg(fields), 4) FROM s
    UNION ALL SELECT 'parsed', CAST(min(parsed) AS BIGINT), CAST(max(parsed) AS BIGINT), round(avg(parsed), 4) FROM s"""
)
def object_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = F.sequence(F.lit(0).cast("long"), F.col("c_nationkey").cast("long"))
    held = table(spark, sf_dir, "customer").select(
        F.map_from_arrays(numbers, numbers).alias("keyed"),
        F.struct("c_custkey", F.nullif("c_nationkey", F.lit(0)).alias("nation")).alias("fields"),
        F.parse_json(F.to_json(F.split("c_name", "0"))).alias("parsed"),
    )
    return profile.extremes(held).select("field", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.round("mean", 4).alias("mean"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field FROM {t} HAVING count(DISTINCT {c}) = count(*) AND count({c}) = count(*)" for t, cs in (("orders", _ORDERS), ("customer", _CUSTOMER)) for c in cs))
def key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.key_candidates(table(spark, sf_dir, "orders")).unionByName(profile.key_candidates(table(spark, sf_dir, "customer")))


@query("SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS null_rows, CAST(count(*) FILTER (n > 1) AS BIGINT) AS repeated_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.key_problems(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, o_custkey FROM orders")
def filter_keys_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.select_fields(table(spark, sf_dir, "orders"), ["O_*KEY"], ["int"])


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding[1:2], lambda x: CAST(round(x) AS INTEGER)), ',') || ']' AS first_two FROM embeddings")
def display_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda x: F.bround(x).cast("int")).alias("first_two"))
    return profile.display_rows(two)


@query()
def display_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole vectors, of which display_containers shows two rounded components; float text differs by engine, so there is no SQL."""
    return profile.display_rows(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, false AS wide" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
def wide_int_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.wide_columns(table(spark, sf_dir, "lineitem"))


# --- lattice, JSON, DDL -----------------------------------------------------------------------------------------------


@query(
    "SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN regexp_matches(w, '^[+-]?[0-9]+$') AND NOT regexp_matches(w, '^[+-]*0[^.]') THEN 'int' "
    "WHEN regexp_matches(w, '^[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$') AND NOT regexp_matches(w, '^[+-]*0[^.]') THEN 'float' "
    "WHEN lower(w) IN ('', 'null', 'none', 'nan', 'n/a', 'na') THEN 'null' WHEN lower(w) IN ('true', 'yes', 'false', 'no') THEN 'bool' ELSE 'str' END AS kind "
    "FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents)) GROUP BY 1"
)
def cell_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("w"))
    bits = words.select(lattice.cell_bit(F.col("w")).alias("bit"))
    return bits.select(lattice.resolved(F.col("bit")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "SELECT '$' AS path, CAST(count(*) AS BIGINT) AS present, CAST(0 AS BIGINT) AS nulls, 'object' AS type FROM events WHERE props IS NOT NULL "
    "UNION ALL SELECT '$.k', CAST(count(*) FILTER (json_exists(props, '$.k')) AS BIGINT), CAST(count(*) FILTER (json_type(props, '$.k') = 'NULL') AS BIGINT), 'int' FROM events"
)
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = structure.structure(table(spark, sf_dir, "events"), "props")
    return out.select("path", "present", "nulls", lattice.resolved(F.col("bits")).alias("type"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_path_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT 'CREATE TABLE \"nation\" (' || chr(10) || '    \"n_nationkey\" INTEGER NOT NULL,' || chr(10) || '    \"n_name\"      TEXT NOT NULL,' || chr(10) || '    \"n_regionkey\" INTEGER NOT NULL,' || chr(10) || '    PRIMARY KEY (\"n_nationkey\")' || chr(10) || ');' AS ddl, 'CREATE INDEX \"idx_nation_n_name\" ON \"nation\" (\"n_name\");' AS indexes")
def ddl_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = table(spark, sf_dir, "nation")
    t = sql_sink.Table("nation", key=("n_nationkey",), indexes=(("n_name",),))
    return spark.createDataFrame([(sql_sink.create_table(t, sql_sink.fields_of(frame)), sql_sink.create_indexes(t))], "ddl string, indexes string")


@query(
    "SELECT CAST(b AS BIGINT) AS batch, 'INSERT INTO \"nation\" (\"n_nationkey\", \"n_name\", \"n_regionkey\") VALUES' || chr(10) || string_agg('    (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ')', ',' || chr(10) ORDER BY n_nationkey) || ';' AS statement "
    "FROM (SELECT *, (row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS b FROM nation) GROUP BY b"
)
def insert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = table(spark, sf_dir, "nation")
    t = sql_sink.Table("nation", batch=10)
    return sql_sink.insert_batches(frame, t, sql_sink.fields_of(frame), [F.col("n_nationkey")])


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def rename_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_sink.renamed(table(spark, sf_dir, "nation"), ["N_NATIONKEY=id", "n name=name"])


# --- time entries -----------------------------------------------------------------------------------------------------

_ENTRIES = "SELECT event_id AS id, event_type AS project, CAST(user_id AS VARCHAR) AS task, ts AS start_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_ts FROM events"
_NOW = "2030-01-01 00:00:00"
_HOURS = f"(SELECT *, epoch_us(coalesce(end_ts, TIMESTAMP '{_NOW}')) / 3.6e9 - epoch_us(start_ts) / 3.6e9 AS hours FROM ({_ENTRIES}))"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("project"), F.col("user_id").cast("string").alias("task"), F.col("ts").cast("timestamp").alias("start_ts"), F.lit(None).cast("timestamp").alias("end_ts"))
    return time_entries.implied_ends(e, "task")


def _now():
    return F.lit(_NOW).cast("timestamp")


@query(f"SELECT project, round(sum(hours), 4) AS hours, CAST(count(*) AS BIGINT) AS entries FROM {_HOURS} GROUP BY 1")
def interval_report_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_entries.report(_entries(spark, sf_dir), ["project"], _now()).select("project", F.round("hours", 4).alias("hours"), "entries")


@query(f"SELECT CAST(year(start_ts) AS INTEGER) AS year, CAST(month(start_ts) AS INTEGER) AS month, round(sum(hours), 4) AS hours, CAST(count(*) AS BIGINT) AS entries FROM {_HOURS} GROUP BY 1, 2")
def interval_report_year_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_entries.report(_entries(spark, sf_dir), ["year,month"], _now()).select("year", "month", F.round("hours", 4).alias("hours"), "entries")


@query(f"SELECT project, CAST(year(start_ts) AS INTEGER) AS year, CAST(month(start_ts) AS INTEGER) AS month, CAST(day(start_ts) AS INTEGER) AS day, round(sum(hours), 4) AS hours, CAST(count(*) AS BIGINT) AS entries FROM {_HOURS} GROUP BY 1, 2, 3, 4")
def interval_report_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_entries.report(_entries(spark, sf_dir), ["day,month,year", "project"], _now()).select("project", "year", "month", "day", F.round("hours", 4).alias("hours"), "entries")


_JALALI = """(SELECT *, 979 + 33 * (n // 12053) + 4 * ((n % 12053) // 1461) + CASE WHEN n % 12053 % 1461 >= 366 THEN (n % 12053 % 1461 - 1) // 365 ELSE 0 END AS jy,
 CASE WHEN n % 12053 % 1461 >= 366 THEN (n % 12053 % 1461 - 1) % 365 ELSE n % 12053 % 1461 END AS dy FROM (SELECT *, date_diff('day', DATE '1600-01-01', CAST({at} AS DATE)) - 79 AS n FROM {source}))"""
_JM = "CASE WHEN dy < 186 THEN 1 + dy // 31 ELSE 7 + (dy - 186) // 30 END"
_JD = "CASE WHEN dy < 186 THEN 1 + dy % 31 ELSE 1 + (dy - 186) % 30 END"


@query(f"SELECT CAST(jy AS INTEGER) AS year, CAST({_JM} AS INTEGER) AS month, round(sum(hours), 4) AS hours, CAST(count(*) AS BIGINT) AS entries FROM {_JALALI.format(at='start_ts', source=_HOURS)} GROUP BY 1, 2")
def interval_report_jalali(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_entries.report(_entries(spark, sf_dir), ["year", "month"], _now(), "jalali").select("year", "month", F.round("hours", 4).alias("hours"), "entries")


@query(f"SELECT task, CAST(count(*) AS BIGINT) AS entries, round(sum(hours), 4) AS hours, max(start_ts) AS last_start FROM {_HOURS} GROUP BY 1")
def interval_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_entries.dimension(_entries(spark, sf_dir), "task", _now()).select("task", "entries", F.round("hours", 4).alias("hours"), F.col("last_start").cast("timestamp_ntz").alias("last_start"))


@query(f"SELECT round(sum(hours), 3) AS hours, CAST(count(*) AS BIGINT) AS entries FROM {_HOURS}")
def interval_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_entries.total(_entries(spark, sf_dir), _now()).select(F.round("hours", 3).alias("hours"), "entries")


@query(f"SELECT id, project, task FROM ({_ENTRIES}) WHERE lower(project) LIKE '%li%'")
def interval_filter_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_entries.filtered(_entries(spark, sf_dir), project="LI").select("id", "project", "task")


@query(f"SELECT id, project, task FROM ({_ENTRIES}) WHERE regexp_matches(task, '^1[0-4]$')")
def interval_filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_entries.filtered(_entries(spark, sf_dir), task_regex="^1[0-4]$").select("id", "project", "task")


@query(f"SELECT id FROM ({_ENTRIES}) WHERE start_ts BETWEEN (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND (SELECT min(ts) FROM events) + INTERVAL 3 DAY")
def interval_filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "events").agg(F.min("ts").cast("timestamp")).first()[0]
    day = intervals.parse_interval("1 day")
    return time_entries.filtered(_entries(spark, sf_dir), start=intervals.apply_interval(F.lit(first), day), end=intervals.apply_interval(F.lit(first), intervals.parse_interval("3d"))).select("id")


@query(f"SELECT id FROM ({_ENTRIES}) WHERE end_ts IS NULL")
def interval_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_entries.filtered(_entries(spark, sf_dir), running=True).select("id")


@query(f"SELECT id, project, start_ts FROM ({_ENTRIES}) ORDER BY start_ts DESC, id DESC LIMIT 1")
def interval_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_entries.latest(_entries(spark, sf_dir)).select("id", "project", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"))


# --- calendar ---------------------------------------------------------------------------------------------------------

_DATES = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)"


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()


@query(f"SELECT d, CAST(jy AS INTEGER) AS jy, CAST({_JM} AS INTEGER) AS jm, CAST({_JD} AS INTEGER) AS jd, d AS back FROM {_JALALI.format(at='d', source=_DATES)}")
def calendar_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = calendar.to_jalali(F.col("d"))
    return _dates(spark, sf_dir).select("d", j["year"].alias("jy"), j["month"].alias("jm"), j["day"].alias("jd"), calendar.from_jalali(j["year"], j["month"], j["day"]).alias("back"))


@query(
    f"SELECT d, monthname(d) AS month, dayname(d) AS weekday, list_extract({list(calendar.JALALI_MONTHS)}, CAST({_JM} AS BIGINT)) AS jalali_month, list_extract({list(calendar.JALALI_WEEKDAYS)}, (dayofweek(d) + 1) % 7 + 1) AS jalali_weekday FROM {_JALALI.format(at='d', source=_DATES)}"
)
def calendar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return _dates(spark, sf_dir).select(
        "d", calendar.month_name("gregorian", F.month(d)).alias("month"), calendar.weekday_name("gregorian", d).alias("weekday"), calendar.month_name("jalali", calendar.to_jalali(d)["month"]).alias("jalali_month"), calendar.weekday_name("jalali", d).alias("jalali_weekday"),
    )


@query(f"SELECT d, CAST(date_trunc('month', d) AS TIMESTAMP) AS first, CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS TIMESTAMP) - INTERVAL 1 SECOND AS last FROM {_DATES}")
def month_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = calendar.bounds("gregorian", F.col("d"), "month")
    return _dates(spark, sf_dir).select("d", first.cast("timestamp_ntz").alias("first"), last.cast("timestamp_ntz").alias("last"))


@query(
    f"""SELECT d, CAST(e // 12 AS INTEGER) AS years, CAST(e % 12 AS INTEGER) AS months, CAST(CASE WHEN day(o) < day(s) THEN day(o) + day(last_day(o - to_days(CAST(day(o) AS INTEGER)))) ELSE day(o) END - day(s) AS INTEGER) AS days
FROM (SELECT d, s, o, (year(o) - year(s)) * 12 + month(o) - month(s) - CASE WHEN day(o) < day(s) THEN 1 ELSE 0 END AS e FROM (SELECT d, d AS s, DATE '2026-03-15' AS o FROM {_DATES}))"""
)
def calendar_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = calendar.difference("gregorian", F.col("d").cast("timestamp"), F.lit("2026-03-15").cast("timestamp"))
    return _dates(spark, sf_dir).select("d", gap["years"].alias("years"), gap["months"].alias("months"), gap["days"].alias("days"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH + INTERVAL 36 HOUR AS later, o_orderdate - INTERVAL 1 MONTH - INTERVAL 36 HOUR AS earlier FROM orders")
def interval_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta, at = intervals.parse_interval("1 mon 1.5 days"), F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", *(intervals.apply_interval(at, delta, k).cast("timestamp_ntz").alias(n) for n, k in (("later", 1), ("earlier", -1))))


@query("SELECT o_orderkey, CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd ' ELSE '' END || CASE WHEN s % 86400 // 3600 > 0 THEN (s % 86400 // 3600) || 'h ' ELSE '' END || CASE WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || 'm ' ELSE '' END || CASE WHEN s % 60 > 0 THEN s % 60 || 's ' ELSE '' END AS took FROM (SELECT o_orderkey, CAST(o_orderkey * 61 + 1 AS BIGINT) AS s FROM orders)")
def duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(intervals.format_duration(F.col("o_orderkey") * 61 + 1), F.lit(" ")).alias("took"))


# --- text -------------------------------------------------------------------------------------------------------------

_TAGS = ("email", "ipv4", "phone", "uuid", "mac", "zip")
_RE2 = {t: text.PATTERNS[t].replace("'", "''") for t in text.PATTERNS}


@query(" UNION ALL ".join(f"SELECT '{t}' AS tag, CAST(coalesce(sum(len(regexp_extract_all(text, '{_RE2[t]}'))), 0) AS BIGINT) AS n, CAST(count(*) FILTER (regexp_matches(text, '{_RE2[t]}')) AS BIGINT) AS docs FROM documents" for t in _TAGS))
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").select(*(text.count_matches(F.col("text"), text.search_pattern(tags=[t])).alias(t) for t in _TAGS))
    one = counts.agg(*(F.struct(F.lit(t).alias("tag"), F.coalesce(F.sum(t), F.lit(0)).alias("n"), F.count_if(F.col(t) > 0).alias("docs")).alias(t) for t in _TAGS))
    return one.select(F.explode(F.array(*_TAGS)).alias("r")).select("r.*")


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{_RE2['email']}')) AS value FROM documents")
def tag_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(text.matches(F.col("text"), text.search_pattern(tags=["email"]))).alias("value"))


@query()
def tag_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag over all languages, with Unicode word boundaries."""
    docs, tags = table(spark, sf_dir, "documents"), list(text.PATTERNS)
    one = docs.agg(*(F.sum(text.count_matches(F.col("text"), text.search_pattern(tags=[t]))).alias(t) for t in tags))
    return one.select(F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.col(t).alias("n")) for t in tags))).alias("r")).select("r.*")


@query("SELECT CAST(count(*) AS BIGINT) AS scanned, CAST(count(*) FILTER (n > 0) AS BIGINT) AS matched, CAST(sum(n) AS BIGINT) AS matches FROM (SELECT len(regexp_extract_all(text, 'Apache')) AS n FROM documents)")
def search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.search_stats(table(spark, sf_dir, "documents"), "text", text.search_pattern("Apache"))


@query("SELECT conv_id, turn, CAST(i AS BIGINT) AS line_no, line, CAST(len(regexp_extract_all(line, '(?i)the')) AS BIGINT) AS n FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations) WHERE regexp_matches(line, '(?i)the')")
def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    return text.line_hits(rows, "id", "text", text.search_pattern("the", ignore_case=True)).select("id.conv_id", "id.turn", "line_no", "line", "n")


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(length(text) AS BIGINT) AS characters, CAST(length(regexp_replace(text, '\\s', '', 'g')) AS BIGINT) AS characters_no_spaces, CAST(strlen(text) AS BIGINT) AS bytes, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nd}_]([\\p{L}\\p{M}\\p{Nd}_''-]*[\\p{L}\\p{M}\\p{Nd}_])?')) AS BIGINT) AS words FROM documents")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *(c.alias(n) for n, c in text.text_counts(F.col("text")).items()))


@query("SELECT word, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 20")
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.top_words(table(spark, sf_dir, "documents"), "text", 20, "[a-z]+")


@query("SELECT doc_id, md5(replace(text, 'the', '[x]')) AS new, CAST(len(regexp_extract_all(text, 'the')) AS BIGINT) AS n FROM documents")
def replace_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, n = text.replace_text(F.col("text"), "the", "[x]")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(new.cast("binary")).alias("new"), n.alias("n"))


@query("SELECT doc_id, md5(regexp_replace(text, '(\\w)-(\\w)', '\\2-\\1', 'g')) AS new FROM documents")
def replace_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, _ = text.replace_text(F.col("text"), r"(\w)-(\w)", r"\2-\1", regex=True)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(new.cast("binary")).alias("new"))


@query(
    "SELECT p_partkey, lower(p_name) AS lower, upper(p_name) AS upper, lower(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[\\s-]+', '_', 'g')) AS snake, "
    "lower(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '[\\s_]+', '-', 'g')) AS kebab, "
    "array_to_string(list_transform(list_filter(regexp_split_to_array(trim(p_name), '[\\s_-]+'), lambda w: w <> ''), lambda w: upper(w[1:1]) || lower(w[2:])), '') AS pascal FROM part"
)
def case_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *(text.convert_case(F.col("p_name"), s).alias(s) for s in ("lower", "upper", "snake", "kebab", "pascal")))


@query()
def case_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *(text.convert_case(F.col("text"), s).alias(s.replace("-", "_")) for s in ("title", "camel", "slug", "slug-unicode")))


@query("SELECT doc_id, md5(base64(encode(text))) AS b64, md5(lower(hex(encode(text)))) AS hexed, md5(url_encode(text)) AS url, true AS back FROM documents")
def encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    back = F.lit(True)
    for scheme in ("base64", "base64url", "hex", "url", "url-plus", "rot13"):
        back = back & (text.decode(text.encode(t, scheme), scheme) == t)
    hashed = [F.md5(text.encode(t, s).cast("binary")).alias(n) for s, n in (("base64", "b64"), ("hex", "hexed"), ("url", "url"))]
    return table(spark, sf_dir, "documents").select("doc_id", *hashed, back.alias("back"))


@query("SELECT doc_id, md5(translate(text, '0123456789,;?%-_', '۰۱۲۳۴۵۶۷۸۹،؛؟٪ــ')) AS fa FROM documents")
def translate_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.translate_text(F.col("text"), "fa").cast("binary")).alias("fa"))


@query("SELECT doc_id, md5(text) AS clean FROM documents")
def strip_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    colored = F.concat(F.lit("\x1b[1;31m"), "text", F.lit("\x1b[0m"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_ansi(colored).cast("binary")).alias("clean"))


@query()
def normalize_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("plain"))


# --- duplicates and partitions ----------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS sha256, CAST(strlen(any_value(text)) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS copies, CAST(strlen(any_value(text)) * (count(*) - 1) AS BIGINT) AS wasted, min(doc_id) AS keep FROM documents GROUP BY text HAVING count(*) > 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("SELECT doc_id AS id, sha256(text) AS sha256, keep FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS keep FROM documents) WHERE doc_id <> keep")
def duplicate_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.duplicate_victims(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("SELECT p_partkey, CAST(ntile(7) OVER (ORDER BY p_partkey) AS INTEGER) AS part FROM part")
def partition_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.split_even(table(spark, sf_dir, "part").select("p_partkey"), 7, [F.col("p_partkey")])


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 64 + 1 AS BIGINT) AS chunk FROM documents")
def partition_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.split_chunks(table(spark, sf_dir, "documents").select("doc_id"), 64, [F.col("doc_id")])


@query("SELECT CASE WHEN upper(p_name[1:1]) BETWEEN 'A' AND 'Z' THEN upper(p_name[1:1]) WHEN p_name[1:1] BETWEEN '0' AND '9' THEN '0-9' ELSE '#' END AS bucket, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def bucket_first_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.bucket_counts(table(spark, sf_dir, "part"), files.first_letter(F.col("p_name")))


@query()
def partition_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.partition_by_size(table(spark, sf_dir, "documents"), "doc_id", F.char_length("text"), parts=5)


@query("SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(count(*) AS BIGINT) AS files FROM documents")
def total_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.total_size(table(spark, sf_dir, "documents"), F.col("text"))


# --- URLs, expressions, top-k -----------------------------------------------------------------------------------------


@query("SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'https?://[^\"''\\s<>)\\]]+')) AS link FROM pages)")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.extract_links(table(spark, sf_dir, "pages"), "page_id", "html", keep_all=True).select("page_id", "link")


@query("SELECT page_id, split_part(url, '://', 1) AS scheme, regexp_extract(url, '://([^/?#:]+)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '#(.*)$', 1) AS fragment, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages")
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = urls.parse_url(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", u["scheme"].alias("scheme"), u["host"].alias("host"), u["path"].alias("path"), u["fragment"].alias("fragment"), F.try_element_at(u["query"], F.lit("page"))[0].alias("page"))


#: Name of a result column: the expression and the same in SQL.
_CALCULATED = {
    "size": ("abs(l_discount - 0.05)", "abs(l_discount - 0.05)"),
    "least": ("min(l_quantity, l_linenumber * 10)", "least(l_quantity, l_linenumber * 10)"),
    "most": ("max(l_quantity, l_linenumber * 10)", "greatest(l_quantity, l_linenumber * 10)"),
    "cube_root": ("cbrt(l_quantity)", "cbrt(l_quantity)"),
    "grown": ("exp(l_discount)", "exp(l_discount)"),
    "natural": ("ln(l_quantity)", "ln(l_quantity)"),
    "base_3": ("log(l_quantity, 3)", "ln(l_quantity) / ln(3)"),
    "base_2": ("log2(l_quantity)", "log2(l_quantity)"),
    "base_10": ("log10(l_extendedprice)", "log10(l_extendedprice)"),
    "power": ("pow(1 + l_discount, l_linenumber)", "pow(1 + l_discount, l_linenumber)"),
    "down": ("floor(l_discount * -10.5)", "floor(l_discount * -10.5)"),
    "up": ("ceil(l_discount * -10.5)", "ceil(l_discount * -10.5)"),
    "cut": ("trunc(l_discount * -10.5)", "trunc(l_discount * -10.5)"),
    "signed": ("copysign(l_quantity, l_discount - 0.05)", "CASE WHEN l_discount - 0.05 < 0 THEN -l_quantity ELSE l_quantity END"),
    "diagonal": ("hypot(l_quantity, l_linenumber)", "sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber)"),
    "divisor": ("gcd(l_orderkey, l_partkey)", "gcd(l_orderkey, l_partkey)"),
    "multiple": ("lcm(l_linenumber, l_suppkey)", "lcm(l_linenumber, l_suppkey)"),
    "arranged": ("factorial(l_linenumber)", "factorial(CAST(l_linenumber AS INTEGER))"),
    "chosen": ("comb(9, l_linenumber)", "factorial(9) / (factorial(CAST(l_linenumber AS INTEGER)) * factorial(CAST(9 - l_linenumber AS INTEGER)))"),
    "placed": ("perm(9, l_linenumber)", "factorial(9) / factorial(CAST(9 - l_linenumber AS INTEGER))"),
    "in_degrees": ("degrees(l_discount)", "degrees(l_discount)"),
    "in_radians": ("radians(l_quantity)", "radians(l_quantity)"),
    "sine": ("sin(l_quantity)", "sin(l_quantity)"),
    "cosine": ("cos(l_quantity)", "cos(l_quantity)"),
    "tangent": ("tan(l_discount)", "tan(l_discount)"),
    "arc_sine": ("asin(l_discount)", "asin(l_discount)"),
    "arc_cosine": ("acos(l_discount)", "acos(l_discount)"),
    "arc_tangent": ("atan(l_quantity)", "atan(l_quantity)"),
    "angle": ("atan2(l_linenumber, l_quantity)", "atan2(l_linenumber, l_quantity)"),
    "sine_h": ("sinh(l_linenumber)", "sinh(l_linenumber)"),
    "cosine_h": ("cosh(l_linenumber)", "cosh(l_linenumber)"),
    "tangent_h": ("tanh(l_discount)", "tanh(l_discount)"),
    "either": ("xor(l_orderkey, l_partkey)", "xor(l_orderkey, l_partkey)"),
}


@query(f"SELECT l_orderkey, l_linenumber, {', '.join(f'round(CAST({sql} AS DOUBLE), 6) + 0.0 AS {name}' for name, (_, sql) in _CALCULATED.items())} FROM lineitem")
def expression_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = table(spark, sf_dir, "lineitem")
    own = {c: F.col(c) for c in frame.columns}
    result = lambda e: F.round(expression.compile_expression(e, own).cast("double"), 6) + 0.0  # noqa: E731  (-0.0 becomes 0.0)
    return frame.select("l_orderkey", "l_linenumber", *(result(e).alias(name) for name, (e, _) in _CALCULATED.items()))


@query("SELECT CAST(p AS INTEGER) AS port FROM (SELECT unnest([22, 80, 443]) AS p UNION SELECT unnest(range(8000, 8011)))")
def port_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("80,443,8000-8010, 22,8005",)], "p string").select(F.explode(urls.expand_ports(F.col("p"))).alias("port"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, CAST(floor(l_orderkey / 7.0) AS BIGINT) AS whole, CAST(((l_orderkey - 50) % 7 + 7) % 7 AS BIGINT) AS rest, round(sqrt(l_quantity ** 2 + 1), 6) AS root, l_quantity > 1 AND l_quantity < 25 AS small FROM lineitem")
def expression_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = table(spark, sf_dir, "lineitem")
    own = {c: F.col(c) for c in frame.columns}
    run = lambda e: expression.compile_expression(e, own)
    return frame.select(
        "l_orderkey", "l_linenumber", F.round(run("l_extendedprice * (1 - l_discount) * (1 + l_tax)"), 6).alias("charge"), run("l_orderkey // 7").cast("long").alias("whole"), run("(l_orderkey - 50) % 7").cast("long").alias("rest"),
        F.round(run("sqrt(l_quantity ^ 2 + 1)"), 6).alias("root"), run("1 < l_quantity < 25").alias("small"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS sent, CAST(count(value) AS BIGINT) AS received, round(100.0 * (count(*) - count(value)) / count(*), 4) AS loss, round(min(value), 6) AS low, round(avg(value), 6) AS mean, round(max(value), 6) AS high FROM events GROUP BY 1")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = processes.latency(table(spark, sf_dir, "events"), "value", ["event_type"])
    return out.select("event_type", "sent", "received", *(F.round(c, 4 if c == "loss" else 6).alias(c) for c in ("loss", "low", "mean", "high")))


@query("SELECT p_partkey, p_brand || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS unique_name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)")
def name_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.with_suffixes(table(spark, sf_dir, "part"), "p_brand", [F.col("p_partkey")]).select("p_partkey", "unique_name")


@query("SELECT o_orderkey AS pid, o_totalprice AS rss FROM orders WHERE contains(lower(o_orderpriority), 'high') ORDER BY rss DESC, pid LIMIT 15")
def process_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand in for processes: the match and order of rows are the same."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("rss"))
    return processes.matching(rows, "HIGH").limit(15).select("pid", "rss")


@query("SELECT o_orderkey AS pid, o_totalprice AS rss FROM orders WHERE contains(lower(o_orderpriority), 'high')")
def process_find_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match, of which process_find shows the largest 15."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("rss"))
    return processes.matching(rows, "HIGH").select("pid", "rss")


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) < 1024 THEN 'B' WHEN octet_length(encode(text)) < 1048576 THEN 'KB' ELSE 'MB' END AS unit FROM documents")
def size_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = text.human_bytes(F.octet_length("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring_index(shown, " ", -1).alias("unit"))


@query()
def markdown_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamgrid.functions import markdown

    return table(spark, sf_dir, "documents").select("doc_id", markdown.markdown_to_html(F.col("text")).alias("html"))


# --- extensions over streams ------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the hourly stream."""
    out = streams.hourly(table(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
