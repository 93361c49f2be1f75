"""Queries and operators give whole results: no row, line, component or level is left out."""

from __future__ import annotations

import json
import re
import struct
import unicodedata

from pyspark.sql import functions as F

from loamgrid.operators import files, structure
from loamgrid.plans import registry
from tests.conftest import SF


def orders_with_high(spark) -> int:
    return spark.read.parquet(f"{SF}/orders.parquet").filter(F.lower("o_orderpriority").contains("high")).count()


def test_process_find_all_gives_every_match(spark):
    whole = orders_with_high(spark)
    assert whole > 15 and registry.QUERIES["process_find_all"](spark, SF).count() == whole


def test_case_slugs_converts_whole_texts(spark):
    """All lines of a text, by plain Python."""

    def camel(t):
        words = [w for w in re.split(r"[\s_\-]+", t.strip()) if w]
        return "".join(w.lower() if k == 0 else w[:1].upper() + w[1:].lower() for k, w in enumerate(words))

    def slug(t, wide):
        t = t.strip()
        t = (t if wide else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()).lower()
        return re.sub(r"[\s_-]+", "-", re.sub(r"[^\w\s-]", "", t)).strip("-")

    def title(t):
        return re.sub(r"\b[\w']+", lambda m: m[0][:1].upper() + m[0][1:].lower(), t)

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert any("\n" in t for t in texts.values())
    rows = registry.QUERIES["case_slugs"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert (r.title, r.camel, r.slug, r.slug_unicode) == (title(t), camel(t), slug(t, False), slug(t, True))


def test_display_vectors_shows_every_component(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    rows = registry.QUERIES["display_vectors"](spark, SF).collect()
    assert len(rows) == len(vectors)
    for r in rows:
        shown = json.loads(r.embedding)
        assert len(shown) > 2 and " " not in r.embedding
        assert struct.pack(f"{len(shown)}f", *shown) == struct.pack(f"{len(shown)}f", *vectors[r.vec_id])


def test_partition_by_size_has_no_most_rows(spark):
    """More rows than were once taken; parts are those of the plain greedy method."""
    n = 1_000_100
    rows = spark.range(n).select("id", (F.col("id") % 1000).alias("size"))
    plan = files.balanced(((k, k % 1000) for k in range(n)), 3)
    out = files.partition_by_size(rows, "id", F.col("size"), parts=3).toPandas()
    assert len(out) == n and [plan[k] for k in out["id"]] == out["part"].tolist()


def test_partition_by_size_over_documents(spark):
    lengths = [(r.doc_id, r.n) for r in spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "char_length(text) AS n").orderBy("doc_id").collect()]
    plan = files.balanced(lengths, 5)
    assert {r.id: r.part for r in registry.QUERIES["partition_by_size"](spark, SF).collect()} == plan
    rows = spark.createDataFrame(lengths, "doc_id long, n long")
    assert {r.id: r.part for r in files.partition_by_size(rows, "doc_id", F.col("n"), capacity=20_000).collect()} == files.filled(lengths, 20_000)


def test_structure_goes_to_the_deepest_path(spark):
    deep = 35
    rows = spark.createDataFrame([('{"a":' * deep + "1" + "}" * deep,)], "j string")
    found = {r.path: r.depth for r in structure.structure(rows, "j").collect()}
    assert found == {"$" + ".a" * k: k for k in range(deep + 1)}
