"""Mixing, packing and URL filters."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import mixing, packing, queries, url_filter

DDL = "doc_id long, text string, lang string, source string, n_tokens long, budget long"


def deal(budget, nodes):
    """Water-filling one node at a time: nodes are (name, weight, capacity)."""
    out, left = {}, sorted(nodes, key=lambda n: (n[2] / n[1], n[0]))
    while left:
        name, weight, capacity = left[0]
        total = sum(n[1] for n in left)
        if capacity * total > weight * budget:
            return out | {n: w * budget // total for n, w, _ in left}
        out[name] = capacity
        budget -= capacity
        left = left[1:]
    return out


def brute_mix(rows, weights, percent, epochs, seed=1):
    docs = [(i, d or "(none)", la or "(none)", s or "(none)", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, la, s, d in rows]
    tokens = defaultdict(int)
    for _, d, la, s, n in docs:
        tokens[d, la, s] += n
    w = lambda level, name: weights.get(level, {}).get(name, 1)
    cap = lambda *key: epochs * sum(n for k, n in tokens.items() if k[: len(key)] == key)
    plan = {}
    top = deal(sum(tokens.values()) * percent // 100, [(d, w("domain", d), cap(d)) for d in {k[0] for k in tokens}])
    for d, b in top.items():
        for la, c in deal(b, [(la, w("lang", la), cap(d, la)) for la in {k[1] for k in tokens if k[0] == d}]).items():
            for s, x in deal(c, [(s, w("source", s), cap(d, la, s)) for s in {k[2] for k in tokens if k[:2] == (d, la)}]).items():
                plan[d, la, s] = x
    out = []
    for leaf, budget in plan.items():
        full, rest = divmod(budget, tokens[leaf]) if tokens[leaf] else (0, -1)
        own = sorted((d for d in docs if d[1:4] == leaf), key=lambda d: (hashlib.md5(f"{seed}:{full}:{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[0] is not None, d[0] or 0, d[4]))
        run = 0
        for d in own:
            run += d[4]
            out.append((*d, full + (run <= rest)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("percent", "epochs"), [(100, 4), (60, 1), (100, 1), (250, 2), (0, 1)])
def test_mixing_against_brute_force(spark, percent, epochs):
    rng = random.Random(percent + epochs)
    rows = [(k, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y", None])) for k in range(300)]
    rows += [(None, "w w", "en", "a", "x"), rows[0], (301, None, None, None, None), (302, "", "zz", "only", "y")]
    weights = {"domain": {"x": 5, "y": 2}, "lang": {"en": 3}, "source": {"b": 7}}
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, capacity string, budget int")
    out = mixing.mix_sources(frame, F.col("capacity"), weights, percent, epochs)
    got = sorted(((r.doc_id, r.domain, r.lang, r.source, r.n_tokens, r.copies) for r in out.collect()), key=str)
    assert got == brute_mix(rows, weights, percent, epochs)
    assert mixing.mix_sources(frame.limit(0), F.col("capacity"), weights).count() == 0


def test_sums_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_BUCKETS", 4)
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 2)
    test_mixing_against_brute_force(spark, 60, 1)


def test_other_columns_are_carried(spark):
    frame = spark.createDataFrame([(1, "w w", "en", "a", 7), (2, "w", "en", "a", None)], "doc_id long, text string, lang string, source string, n int")
    out = mixing.mix_sources(frame, F.lit("x"), {}, carry=("n", "text"))
    assert {(r.doc_id, r.n, r.text, r.copies) for r in out.collect()} == {(1, 7, "w w", 1), (2, None, "w", 1)}


def test_shortage_goes_to_siblings_first(spark):
    rows = [(k, "w " * 100, "en", s, d) for k, (s, d) in enumerate([("small", "x")] * 1 + [("large", "x")] * 50 + [("other", "y")] * 50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    out = mixing.mix_sources(frame, F.col("domain"), {}, percent=50, most_epochs=1).filter("copies > 0").groupBy("domain").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.domain: r.n for r in out} == {"x": 2500, "y": 2500}  # 100 of the small source's 1262 went to its sibling


def test_weights_are_checked(spark):
    with pytest.raises(ValueError):
        mixing.weight_of(F.lit("a"), {"a": 0})


@pytest.fixture(scope="module")
def slow():
    return packing.Encoder(queries.tokenizer_files()[0], None, None)


def test_packing(spark, slow):
    rng = random.Random(3)
    words = ["river", "Stone", "été,", "über", "don't", "123", "4.5", "  ", "\n\n", "…", "🙂", "中文", "x" * 50, "\u00a0", "½", "<|endoftext|>"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 900)))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, "a " * 7000), (None, "null id"), rows[5], (203, " \n \t  x")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, `group` int, crc int")
    out = packing.pack_sequences(frame, *queries.tokenizer_files()).collect()
    want = []
    for i, t in rows:
        ids = np.array([*slow.slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cuts(len(ids), 2048))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=str) == sorted(want, key=str)
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= 1.02 * -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.pack_sequences(frame.limit(0), *queries.tokenizer_files()).count() == 0


def test_fast_ids_are_the_slow_ones(slow):
    fast = packing.Encoder(*queries.tokenizer_files())
    rng = random.Random(9)
    alphabet = "abcXYZéß'  \n\t0129½²³Ⅷ中文🙂\u0301\u200d\u00a0\u3000.,!?-_#|"
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert fast.ids(text) == slow.ids(text), repr(text)
    assert fast.ids("a <|endoftext|> b") == slow.ids("a <|endoftext|> b")


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(rule):
    rng = np.random.default_rng(4)
    length = rng.integers(1, 100, 500)
    demands = np.stack([length, np.ones(500), length**2], 1).astype(float)
    capacity = np.array([100, 6, 100.0**2 / 2 + 5000])
    bins = packing.vector_best_fit(demands, capacity, np.array([1.0, 0.1, 0.1]), rule)
    for b in range(bins.max() + 1):
        assert (demands[bins == b].sum(0) <= capacity + 1e-6).all() and (bins == b).any()
    with pytest.raises(ValueError):
        packing.vector_best_fit(np.array([[200.0, 1, 1]]), capacity, np.ones(3), rule)


def test_cuts():
    assert packing.cuts(0, 10) == [(0, 0)] and packing.cuts(10, 10) == [(0, 10)] and packing.cuts(11, 10) == [(0, 1), (1, 10)] and packing.cuts(30, 10) == [(0, 10), (10, 10), (20, 10)]


URLS = [
    None, "", "no scheme", "http://a.net", "http://a.net/", "HTTP://A.NET/x", "https://example.net/en/1", "https://www.EXAMPLE.net/en/", "https://example.net/en", "https://example.net/EN/1", "https://notexample.net/en/1", "http://x.example.com/de/1?q=a",
    "http://example.com/des/1", "http://wiki.org/fr/a#b", "http://org/fr/", "http://borg/fr/", "http://a.org/casino/1", "http://a.org/casinos/1", "http://cheap-pills.org/", "http://cheap.pills.org/", "http://a.b:80/net/", "x://y?net/", "http://net/en/", "http://example.net/en/casino",
    "http://a.org/%E9/casino?x", "://example.net/en/", "http://é.net/x", "http://a.net/" + "x/" * 5000,
]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in queries.SITE_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    if best:
        return host, path, *best
    words = "|".join((*queries.BLOCKED_WORDS, *queries.BLOCKED_PHRASES))
    return host, path, None, "block" if re.search(rf"(^|[^a-z0-9])({words})([^a-z0-9]|$)", (url or "").lower()) else "allow"


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_urls(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", broadcast)
    frame = spark.createDataFrame([*((k, u, "h", "s") for k, u in enumerate(URLS)), (None, URLS[6], "", ""), (6, URLS[6], "", "")], "page_id long, url string, host string, site string")
    out = url_filter.filter_urls(frame, queries.url_rules()).collect()
    assert len(out) == len(URLS) + 2
    sites = {s for s, _ in queries.SITE_RULES}
    for r in out:
        want = judge(URLS[6 if r.page_id is None else r.page_id])
        assert (r.host, r.path, r.rule if r.rule in sites else None, r.verdict) == want, r
    assert url_filter.filter_urls(frame.limit(0), queries.url_rules()).count() == 0


def test_rules_are_indexed_by_rare_tokens(spark):
    urls = spark.createDataFrame([("http://a.example.net/en/1",), ("http://b.example.net/fr/en",), ("http://c.example.com/x",), (None,)], "u string")
    counts = url_filter.literal_counts(urls, F.col("u"), queries.url_rules())
    assert counts == {"example": 3, "net": 2, "en": 2, "com": 1, "fr": 1}
    index = {name: token for token, name, *_ in url_filter.rule_index(queries.url_rules(), counts)}
    assert index["net/"] == "net" and index["example.net/en/"] in ("en", "net") and index["org/fr/"] == "org" and index["example.com/de/"] == "de"
