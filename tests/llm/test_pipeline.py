"""Every stage of the pipeline against a brute-force version on the same rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamgrid.llm import quality_classifier as qc
from loamgrid.llm import queries
from tests.conftest import SF
from tests.llm.test_mix_pack_urls import brute_mix
from tests.llm.test_quality import brute_model
from tests.llm.test_text_dedup import brute_lines, brute_print, components


def domain(source: str | None) -> str | None:
    found = [name for name, numbers in queries.DOMAINS.items() if source in {f"src{k}" for k in numbers}]
    return found[0] if found else "other"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that each stage reads and the last one's result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(180)
    extra = spark.createDataFrame([(None, "Ein Satz steht hier allein.\nNoch einer.\nUnd noch einer.", "de", "src3", 5), (None, "Ein Satz steht hier allein.\nNoch einer.\nUnd noch einer.", "de", "src3", 5), (None, None, None, None, None)], docs.schema)
    frames = [docs.unionByName(extra).cache()]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
    return frames


def rows(frame):
    return [tuple(r) for r in frame.select(*corpus_pipeline.COLUMNS).collect()]


def test_quality(spark, stages):
    docs = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    table = qc.feature_table(docs)
    q = table.agg(*(F.percentile_approx(F.col("x")[k], list(qc.QUANTILES)) for k in range(qc.N_FEATURES))).first()
    folds = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("f")).collect()}
    own = rows(docs)
    model = brute_model([r[:2] for r in own], labels, folds, [list(v) for v in q])
    score = model.score(np.array([qc.features((r[1] or "").encode()) for r in own], np.float32).astype(float))
    assert Counter(rows(stages[1])) == Counter(r for r, s in zip(own, score, strict=True) if s >= 0.3)


def test_lines(stages):
    own = rows(stages[1])
    want = Counter((i, text) for i, text, _, _ in brute_lines([r[:2] for r in own], 3))
    got = rows(stages[2])
    assert Counter(r[:2] for r in got) == want and all(r[4] == len(r[1]) for r in got)
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((r[0], r[2], r[3]) for r in own)


def test_near_duplicates(stages):
    own = sorted(rows(stages[2]), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [brute_print(r[1]) for r in own]
    label = components(len(own), [(a, b) for a in range(len(own)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    got = rows(stages[3])
    without = [brute_print(r[1]) for r in got if r[0] is None]
    assert Counter(r for r in got if r[0] is not None) == Counter(own[c] for c in set(label) if own[c][0] is not None)
    assert sorted(without) == sorted(prints[c] for c in set(label) if own[c][0] is None)  # of rows without an id one of a group


def test_mix(stages):
    own = rows(stages[3])
    want = brute_mix([(i, t, la, s, domain(s)) for i, t, la, s, _ in own], queries.MIX_WEIGHTS, 90, 1)
    assert Counter(r[0] for r in rows(stages[4])) == Counter(r[0] for r in want if r[-1])
    assert Counter(rows(stages[4])) <= Counter(own)


def test_pack(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_files()[0])
    want = Counter()
    for i, text, *_ in rows(stages[4]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or min(2048, len(ids))
        for piece, at in enumerate([0, *range(first, len(ids), 2048)]):
            length = first if piece == 0 else 2048
            want[i, piece, at, length, zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())] += 1
    got = stages[5].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_is_its_stages(spark):
    whole = corpus_pipeline.run(spark, SF).collect()
    assert len({(r.doc_id, r.piece) for r in whole}) == len(whole) > 0


def test_many_rows_without_an_id(spark):
    texts = [f"Line {k % 40} of this text.\nAnd one more, {k % 3}.\nThen the end of it." + " Word." * (k % 50) for k in range(1200)]
    docs = spark.createDataFrame([(None if k % 2 else 7, t, "en", "src1", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").cache()
    lined = corpus_pipeline.lines(spark, docs, SF).cache()
    assert Counter((r.doc_id, r.text) for r in lined.collect()) == Counter((i, t) for i, t, *_ in brute_lines([(r.doc_id, r.text) for r in docs.collect()], 3))
    kept = corpus_pipeline.near_duplicates(spark, lined, SF).collect()
    prints = [brute_print(r.text) for r in kept]
    assert len(set(prints)) == len(prints) == len(set(components(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])))
    assert re.match("Line", kept[0].text or "Line")
