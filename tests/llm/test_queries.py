"""The registered queries against their SQL, and the pipeline against its parts."""

from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from loamgrid.llm import queries
from tests.conftest import SF, same


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck, queries.ORACLE[name])


def test_each_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)), name
        sizes.append(len(ids))
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == set(ids)
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, last))
    used = defaultdict(int)
    for r in whole:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "a\nb\nc", "en", "src1", 5), (1, "a\nb\nc", "en", "src1", 5), (2, None, None, None, None), (3, "", None, None, 0), (None, "x y z", None, "src9", 5), (4, "word " * 5000, "en", "src0", 25000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, str(tmp_path)).collect()


@pytest.mark.parametrize("name", ["op3_pii", "op10_url_filter"])
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_scans_read_what_they_need(spark):
    plan = queries.QUERIES["op10_url_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan
    plan = queries.QUERIES["op5_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "source" not in plan and "lang" not in plan
