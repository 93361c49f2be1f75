"""Reading, typing, profiling, SQL output, time entries and files."""

from __future__ import annotations

import datetime as dt
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from loamgrid.errors import DataError
from loamgrid.functions import intervals, lattice, names
from loamgrid.operators import files, profile, render, sql_sink, structure, time_entries
from loamgrid.sources import readers
from loamgrid.streaming import events

CELLS = {
    "": "null", " NaN ": "null", "N/A": "null", "true": "bool", "No": "bool", "12": "int", "+3": "int", "-0": "int", "0": "int", "007": "str", "-0012": "str", "1.5": "float", ".5": "float", "1e3": "float", "0.5": "float", "00.5": "str", "inf": "str", "۱۲": "int", "2024-02-29": "date", "2023-02-29": "str",
    "2024-02-29T10:20": "datetime", "2024-02-29 10:20:30.25+0200": "datetime", "2024-02-29 25:00": "str", "99999999999999999999": "int", "x": "str",
}


def test_cells(spark):
    rows = spark.createDataFrame(list(enumerate(CELLS)), "id long, t string").select("id", "t", lattice.resolved(lattice.cell_bit(F.col("t"))).alias("kind"))
    assert {r.t: r.kind for r in rows.collect()} == CELLS


def test_lattice_is_a_join():
    for a in lattice.TYPES:
        assert lattice.unify([a]) == lattice.unify([a, a]) == lattice.unify([a, "null"]) == a
        for b in lattice.TYPES:
            assert lattice.unify([a, b]) == lattice.unify([b, a])
            for c in lattice.TYPES:
                assert lattice.unify([lattice.unify([a, b]), c]) == lattice.unify([a, b, c])
    assert [lattice.unify(x) for x in (("int", "float"), ("date", "datetime"), ("bool", "int"), ("int", "date"), ("list", "str"), ("list", "object"))] == ["float", "datetime", "str", "str", "json", "json"]


def test_names():
    got = {k: names.sanitize(k) for k in ("First Name", "userID", "HTTPServer", "Prénom", "نام واحد", "2nd", "", "--", "a  b/c.d", "é" * 50)}
    assert got == {"First Name": "first_name", "userID": "user_id", "HTTPServer": "http_server", "Prénom": "prenom", "نام واحد": "نام_واحد", "2nd": "_2nd", "": "column", "--": "column", "a  b/c.d": "a_b_c_d", "é" * 50: "e" * 50}
    assert len(names.sanitize("ن" * 60).encode()) <= 63
    assert names.unique_names(["a", "A", "a_2", "A "]) == ["a", "a_2", "a_2_2", "a_3"]
    assert names.header_names(["id", None, "id", " x "]) == ["id", "column_2", "id_2", "x"]
    assert names.index_name("My Table", ["a", "B c"]) == "idx_my_table_a_b_c"


def test_csv(spark, tmp_path):
    (tmp_path / "sales.csv").write_text("﻿id;name;joined;zip;amount;flag;\n1;Ada;2024-01-02;01730;10;yes;n/a\n2;\"Bo;b\";2024-02-03;02139;2.5;no;x\n;;;;;;\n3;Cy\n", encoding="utf-8")
    source = readers.load(spark, f"{tmp_path}/sales.csv")
    assert source.delimiter == ";" and source.frame.columns == ["id", "name", "joined", "zip", "amount", "flag", "column_7"]
    assert dict(source.frame.dtypes) == {"id": "bigint", "name": "string", "joined": "date", "zip": "string", "amount": "double", "flag": "boolean", "column_7": "string"}
    rows = [tuple(r) for r in source.frame.orderBy("id").collect()]
    assert rows == [(1, "Ada", dt.date(2024, 1, 2), "01730", 10.0, True, "n/a"), (2, "Bo;b", dt.date(2024, 2, 3), "02139", 2.5, False, "x"), (3, "Cy", None, None, None, None, None)]
    text = readers.load(spark, f"{tmp_path}/sales.csv", infer=False, limit=1)
    assert text.frame.count() == 1 and {t for _, t in text.frame.dtypes} == {"string"}


def test_json(spark, tmp_path):
    users = [{"id": 1, "tags": ["a"]}, {"id": 2, "note": "x"}]
    (tmp_path / "env.json").write_text(json.dumps({"meta": {"page": 1}, "data": {"users": users}}, indent=1))
    source = readers.load(spark, f"{tmp_path}/env.json")
    assert source.root == "data.users" and source.frame.count() == 2 and source.notes
    (tmp_path / "two.json").write_text(json.dumps({"a": users, "b": {"c": users}}))
    with pytest.raises(DataError, match="b.c"):
        readers.load(spark, f"{tmp_path}/two.json")
    assert readers.load(spark, f"{tmp_path}/two.json", root="b.c").frame.count() == 2
    with pytest.raises(DataError, match="'x'"):
        readers.load(spark, f"{tmp_path}/two.json", root="b.x")
    (tmp_path / "rows.ndjson").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.load(spark, f"{tmp_path}/rows.ndjson").frame.count() == 2
    (tmp_path / "list.json").write_text('{"v": [1, 2, 3]}')
    assert [r.value for r in readers.load(spark, f"{tmp_path}/list.json", root="v").frame.collect()] == [1, 2, 3]
    for path in ("a.xyz",):
        with pytest.raises(DataError):
            readers.detect_kind(path)


def test_structure(spark):
    docs = ['{"id":1,"age":3,"at":{"city":"x"},"tags":["a","b"]}', '{"id":2,"age":2.5,"at":{"city":null}}', '{"id":3,"age":null,"note":"n","at":null}']
    root = structure.tree(spark.createDataFrame([(d,) for d in docs], "j string"), "j")
    age, note, city = root.children["age"], root.children["note"], root.children["at"].children["city"]
    assert (age.label, age.type, age.present, age.total, age.nulls, age.nullable) == ("int|float", "float", 3, 3, 1, True)
    assert (note.present, note.total, note.missing) == (1, 3, 2)
    assert (city.present, city.total, city.missing) == (2, 2, 1)  # of the objects above it
    assert (root.children["tags"].label, root.children["tags"].item.total) == ("list[str]", 2)
    assert "age: int|float" in structure.render_tree(root)
    mixed = structure.tree(spark.createDataFrame([('{"a":1}',), ('{"a":"x"}',), ("no json",)], "j string"), "j")
    assert (mixed.children["a"].label, mixed.children["a"].type) == ("int|str", "str")


def test_profile(spark):
    frame = spark.createDataFrame([(1, "a", True, [1]), (2, "b", False, [1, 2]), (3, "b", None, None), (4, None, True, [])], "id long, t string, f boolean, l array<int>")
    rows = {r.field: r for r in profile.summary(frame).collect()}
    assert (rows["t"].non_null, rows["t"].nulls, rows["t"].distinct, rows["t"].top, rows["t"].top_count) == (3, 1, 2, "b", 2)
    assert rows["id"].top is None and (rows["id"].low, rows["id"].high, rows["id"].mean) == ("1", "4", 2.5)
    assert (rows["f"].trues, rows["f"].falses) == (2, 1) and (rows["l"].low, rows["l"].high, rows["l"].mean) == ("0", "2", 1.0)
    assert [r.field for r in profile.key_candidates(frame).collect()] == ["id"]
    assert tuple(profile.key_problems(frame, ["t"]).first()) == (4, 1, 1)
    assert profile.select_fields(frame, ["T", "i*"]).columns == ["id", "t"] and profile.select_fields(frame, types=["json"]).columns == ["l"]
    assert profile.display_rows(frame, 1).first().l == "[1]"
    empty = frame.withColumn("e", F.lit(None).cast("string"))
    assert "e" not in profile.select_fields(empty, drop_empty=True).columns
    for bad in (lambda: profile.select_fields(frame, ["zz"]), lambda: profile.select_fields(frame, types=["what"]), lambda: profile.key_problems(frame, ["zz"])):
        with pytest.raises(DataError):
            bad()
    assert [spark.range(1).select(profile.number_text(F.lit(v)).alias("n")).first().n for v in (3.0, 0.5, 123456.789)] == ["3", "0.5", "1.235e+05"]
    assert spark.range(1).select(profile.clip(F.lit("x" * 40)).alias("c")).first().c == "x" * 27 + "…"
    wide = spark.createDataFrame([("9223372036854775808", "1")], "a string, b string").select(*(F.col(c).cast("decimal(38,0)").alias(c) for c in "ab"))
    assert {r.field: r.wide for r in profile.wide_columns(wide).collect()} == {"a": True, "b": False}


def test_sql_script_runs(spark):
    frame = spark.createDataFrame([(k, f"it's {k}", k / 2 if k else float("nan"), bool(k % 2), [k], None if k else "n") for k in range(250)], "id long, name string, score double, ok boolean, tags array<int>, note string")
    table = sql_sink.Table("my table", key=("id",), indexes=(("name",),), if_exists="replace")
    rows = sql_sink.script(frame, table, [F.col("id")]).orderBy("part").collect()
    database = sqlite3.connect(":memory:")
    database.executescript("\n".join(r.statement for r in rows))
    assert database.execute('SELECT count(*), min(name), sum(ok), max(score) FROM "my table"').fetchone() == (250, "it's 0", 125, 124.5)
    assert database.execute('SELECT score, tags, note FROM "my table" WHERE id = 0').fetchone() == (None, "[0]", "n")
    postgres = sql_sink.Table("t", dialect="postgres")
    ddl = sql_sink.create_table(postgres, sql_sink.fields_of(frame))
    assert '"tags"  jsonb NOT NULL' in ddl and '"score" double precision,' in ddl and '"note"  text,' not in ddl
    with pytest.raises(DataError, match="more than once"):
        sql_sink.validate(frame.withColumn("id", F.lit(1)), table, sql_sink.fields_of(frame))
    with pytest.raises(DataError, match="null in 249"):
        sql_sink.validate(frame, sql_sink.Table("t", key=("note",)), sql_sink.fields_of(frame))
    with pytest.raises(DataError):
        sql_sink.Table("t", dialect="oracle")
    bound = sql_sink.parameters(frame).filter("id = 1").first()
    assert (bound.ok, bound.tags) == (1, "[1]")


def test_renames():
    columns = ["First Name", "age", "Zip"]
    assert sql_sink.rename_plan(columns, ["first_name=name", "AGE=years"]) == {"First Name": "name", "age": "years"}
    assert sql_sink.rename_plan(columns, ["age=Zip", "Zip=age"]) == {"age": "Zip", "Zip": "age"}
    for bad in (["age"], ["nope=x"], ["age=Zip"], ["age=a", "AGE=b"]):
        with pytest.raises(DataError):
            sql_sink.rename_plan(columns, bad)


def test_rendering(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", True), (22, None, False)], "id long, name string, ok boolean")
    assert render.text_table(frame).split("\n") == ["id | name | ok", "---+------+------", "1  | a    | true", "22 |      | false"]
    assert render.markdown_table(frame).startswith("| id | name | ok |\n| --- |")
    assert render.json_lines(frame).collect()[1].value == '{"id":22,"name":null,"ok":false}'
    render.write(frame, f"{tmp_path}/out", "csv")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/out").count() == 2
    with pytest.raises(DataError):
        render.write(frame, f"{tmp_path}/o2", "doc")


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(1, "alpha", "task one", "2026-04-24 09:00:00", "2026-04-24 11:00:00"), (2, "beta", "task two", "2026-04-25 09:00:00", "2026-04-25 10:00:00"), (3, None, "Other", "2026-05-01 08:00:00", None)]
    return spark.createDataFrame(rows, "id long, project string, task string, s string, e string").select("id", "project", "task", F.col("s").cast("timestamp").alias("start_ts"), F.col("e").cast("timestamp").alias("end_ts"))


def test_time_entries(entries):
    now = F.lit("2026-05-01 14:30:00").cast("timestamp")
    closed = time_entries.filtered(entries, running=False)
    assert tuple(time_entries.total(closed, now).first()) == (3.0, 2, "03:00")
    assert [(r.project, r.hours) for r in time_entries.report(entries, ["project"], now).collect()] == [("alpha", 2.0), ("beta", 1.0), (None, 6.5)]
    assert [(r.year, r.month) for r in time_entries.report(entries, ["month,year"], now, "jalali").collect()] == [(1405, 2)]
    assert [r.project for r in time_entries.dimension(entries, "project", now).collect()] == ["(none)", "alpha", "beta"]
    pick = lambda **k: [r.id for r in time_entries.filtered(entries, **k).orderBy("id").collect()]
    assert pick(project="ALPH") == [1] and pick(task="task%") == [] and pick(task_regex="^task") == [1, 2] and pick(project_regex=".") == [1, 2] and pick(ids=[2, 9]) == [2] and pick(running=True) == [3]
    assert pick(within=intervals.parse_interval("6 days 6 hours"), now=now) == [2, 3] and pick(end=F.lit("2026-04-25 09:00:00").cast("timestamp")) == [1, 2]
    for bad in (["month"], ["day", "year"], ["week"]):
        with pytest.raises(DataError):
            time_entries.group_fields(bad)
    assert time_entries.latest(entries).first().id == 3
    assert [r.id for r in time_entries.long_running(entries, now).collect()] == [3]
    assert [r.end_ts is None for r in time_entries.implied_ends(entries.withColumn("end_ts", F.lit(None).cast("timestamp"))).orderBy("id").collect()] == [False, False, True]
    new = entries.filter("id = 1").withColumn("id", F.lit(4).cast("long")).withColumn("end_ts", F.lit(None).cast("timestamp"))
    started = time_entries.started(entries, new, now)
    assert [r.id for r in started.filter("end_ts IS NULL").collect()] == [4] and time_entries.ended(entries, now).filter("end_ts IS NULL").count() == 0
    assert time_entries.edited(entries, F.col("id") == 2, task=F.lit("new")).filter("task = 'new'").count() == 1
    with pytest.raises(Exception, match="ends before"):
        time_entries.edited(entries, F.col("id") == 2, end_ts=F.lit("2020-01-01").cast("timestamp")).collect()
    assert [r.id for r in time_entries.deleted(entries, F.col("project") == "alpha").orderBy("id").collect()] == [2, 3]
    start = time_entries.report(entries, ["year,month"], now).select(time_entries.period_start("gregorian", ["year", "month"]).alias("p")).collect()
    assert [r.p for r in start] == [dt.datetime(2026, 4, 1), dt.datetime(2026, 5, 1)]


def test_files(spark, tmp_path):
    for name, content in {"a/one.txt": b"alpha", "a/two.txt": b"beta", "b/three.txt": b"alpha", "b/notes.md": b"# title", "b/bin.txt": b"a\0b", "b/ctl.txt": b"\x01\x02\x03a"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    docs = files.text_files(spark, str(tmp_path), glob="*.txt")
    assert sorted(r.path.rsplit("/", 1)[1] for r in docs.collect()) == ["one.txt", "three.txt", "two.txt"]
    assert files.text_files(spark, str(tmp_path), name_regex="^n", exclude=["*.txt"], most_bytes=10).count() == 1
    groups = files.duplicate_groups(docs, "path", F.col("text")).collect()
    assert [(g.copies, g.size, g.wasted) for g in groups] == [(2, 5, 5)] and groups[0].keep.endswith("a/one.txt")
    assert [r.id.rsplit("/", 1)[1] for r in files.duplicate_victims(docs, "path", F.col("text")).collect()] == ["three.txt"]
    assert files.total_size(docs, F.col("text")).first().bytes == 14
    buckets = files.bucket_counts(files.text_files(spark, str(tmp_path)), files.extension(F.col("path"))).collect()
    assert {r.bucket: r.n for r in buckets} == {".txt": 3, ".md": 1}


def test_partitions(spark):
    rows = spark.range(10)
    assert [r.part for r in files.split_even(rows, 3, [F.col("id")]).orderBy("id").collect()] == [1] * 4 + [2] * 3 + [3] * 3
    assert [r.chunk for r in files.split_chunks(rows, 4, [F.col("id").desc()]).orderBy("id").collect()] == [3, 3, 2, 2, 2, 2, 1, 1, 1, 1]
    assert files.balanced([("a", 5), ("b", 4), ("c", 3), ("d", 2)], 2) == {"a": 1, "b": 2, "c": 2, "d": 1}
    assert files.filled([("big", 30), ("a", 10), ("b", 10), ("c", 1)], 20) == {"big": 1, "a": 2, "b": 2, "c": 2}
    assert sorted(r.part for r in files.partition_by_size(rows, "id", F.col("id"), parts=2).collect()) == [1] * 5 + [2] * 5
    left, right = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, size long"), spark.createDataFrame([("a", 1), ("b", 9)], "name string, size long")
    assert {r.name: r.action for r in files.name_collisions(left, right, "same-size").collect()} == {"a": "overwrite", "b": "skip", "c": "move"}
    names_ = spark.createDataFrame([("a1",), ("a2",), ("b1",)], "n string")
    assert {r.old: r.action for r in files.batch_rename(names_, "n", r"\d", "").collect()} == {"a1": "skip", "a2": "skip", "b1": "rename"}
    texts = files.random_texts(spark, 3, 2)
    assert texts.count() == 3 and texts.collect() == files.random_texts(spark, 3, 2).collect()


def test_numbering_a_large_order(spark):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("h"), "id").repartition(7)
    out = files.ranked(rows, [F.col("h"), F.col("id")], "row", ranges=9)
    assert out.agg(F.min("row"), F.max("row"), F.countDistinct("row")).first() == (0, 199_999, 200_000)
    above = out.select("h", "row").orderBy("row").toPandas()
    assert above.h.is_monotonic_increasing


def test_stream(spark, tmp_path):
    rows = [(k, f"2024-01-01 0{k % 3}:00:00", k % 2, "click", float(k)) for k in range(12)]
    frame = spark.createDataFrame(rows, "event_id long, t string, user_id int, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    frame.write.parquet(f"{tmp_path}/in")
    stream = events.hourly(events.read(spark, f"{tmp_path}/in", frame.schema.simpleString()[7:-1].replace(":", " ")))
    query = stream.writeStream.format("memory").queryName("hours").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, events.hourly(frame).collect()))
    assert sorted(r.n for r in events.sessions(frame, gap="30 minutes").collect()) == [2] * 6


def test_csv_is_split_unless_a_cell_spans_lines(spark, tmp_path):
    (tmp_path / "flat.csv").write_text('a,b\n1,"x ""y"" z"\n\n2,\n', encoding="utf-8")
    (tmp_path / "long.csv").write_text('a,b\n1,"x\n""y"", z"\n2,w\n', encoding="utf-8")
    assert [readers.spans_lines(spark, f"{tmp_path}/{n}.csv") for n in ("flat", "long")] == [False, True]
    assert sorted(map(tuple, readers.load(spark, f"{tmp_path}/flat.csv").frame.collect())) == [(1, 'x "y" z'), (2, None)]
    assert sorted(map(tuple, readers.load(spark, f"{tmp_path}/long.csv").frame.collect())) == [(1, 'x\n"y", z'), (2, "w")]


def test_json_lines_under_any_name(spark, tmp_path):
    (tmp_path / "lines.json").write_text('\n{"a": 1}\n{"a": 2}\n')
    (tmp_path / "whole.json").write_text('[\n{"a": 1},\n{"a": 2}\n]')
    (tmp_path / "bad.json").write_text('{"a": 1\n')
    for name in ("lines", "whole"):
        assert sorted(r.a for r in readers.load(spark, f"{tmp_path}/{name}.json").frame.collect()) == [1, 2]
    with pytest.raises(DataError):
        readers.load(spark, f"{tmp_path}/bad.json")


def test_container_sizes_are_items(spark):
    frame = spark.sql("SELECT map('a', 1, 'b', 2) AS m, named_struct('x', 1, 'y', CAST(NULL AS INT)) AS s, parse_json(v) AS v FROM VALUES ('{\"a\": 1, \"b\": [1]}'), ('[1, 2, 3]'), ('7'), (NULL) AS t(v)")
    rows = {r.field: (r.low, r.high, r["mean"]) for r in profile.extremes(frame).collect()}
    assert rows == {"m": ("2", "2", 2.0), "s": ("1", "1", 1.0), "v": ("1", "3", 2.0)}
