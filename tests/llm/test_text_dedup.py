"""Substring dedup, line dedup and SimHash against brute force and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loamgrid.llm import common, line_dedup, simhash_dedup, substring_dedup, windows
from loamgrid.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, bucket string, part int, rest string"


def frame(spark, rows):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "b", 1, "r") for i, t in rows], DDL)


def corpus(seed: int, n: int = 40) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["é", "ß,", "\u2028x", "a\x00b"]
    passages = [" ".join(rng.choices(words, k=9)) for _ in range(4)]
    rows: list[tuple[int | None, str | None]] = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(4)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 4), rng.choice(passages))
        rows.append((i * 3 % 41, rng.choice([" ", "\n", "\t\r\n"]).join(parts)))
    rows += [(100, None), (101, ""), (102, " \n "), rows[0], rows[0], (rows[1][0], "w1 w2"), (None, rows[2][1]), (None, rows[3][1]), (103, "w1 " * 400), (104, "w1 " * 400)]
    return rows


def brute_substrings(rows, width):
    first: dict[tuple, int] = {}
    for i, t in rows:
        words = WORD.findall(t or "")
        for k in range(len(words) - width + 1):
            key = tuple(words[k : k + width])
            first[key] = min(first.get(key, 1 << 64), (1 << 64) if i is None else i)
    out = []
    for i, t in rows:
        words = WORD.findall(t or "")
        own, gone = (1 << 64) if i is None else i, set()
        for k in range(len(words) - width + 1):
            if first[tuple(words[k : k + width])] < own:
                gone |= set(range(k, k + width))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substrings_against_brute_force(spark, seed):
    rows = corpus(seed)
    out = substring_dedup.substring_dedup(frame(spark, rows), width=5)
    mine = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out.collect()]
    assert sorted(mine, key=str) == brute_substrings(rows, 5)
    for r in out.collect():
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def crowd(seed: int, n: int = 2000) -> list[tuple[int | None, str]]:
    """Rows without an id and rows that share one, of different lengths, full of repeated passages."""
    rng = random.Random(seed)
    passages = ["\n".join(f"p{k} q{j} r{k * j % 5}" for j in range(4)) for k in range(6)]
    text = lambda: "\n".join([*(rng.choice(passages) for _ in range(rng.randint(0, 3))), *(f"own {rng.random()}" for _ in range(rng.randint(0, 40)))])
    return [(rng.choice([None, None, 7, 7, 3, rng.randrange(50), (1 << 63) - 1, -(1 << 63)]), text()) for _ in range(n)] + [(None, "")] * 3


@pytest.mark.parametrize("same_key", [False, True])
def test_many_rows_without_an_id_or_with_one_id(spark, monkeypatch, same_key):
    if same_key:  # whatever differs in text shares a key
        monkeypatch.setattr(windows, "text_bits", lambda doc_id, raw, by_document: len(raw) % 2 if by_document and doc_id is not None else xxhash.xxh3_64_intdigest(raw))
    rows = crowd(11)
    out = substring_dedup.substring_dedup(frame(spark, rows).repartition(5), width=5)
    mine = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out.collect()]
    assert sorted(mine, key=str) == brute_substrings(rows, 5)


def test_lines_of_many_rows_without_an_id_or_with_one_id(spark):
    rows = crowd(12)
    out = line_dedup.line_dedup(frame(spark, rows).repartition(5), width=3)
    mine = [(r.doc_id, r.kept_text, r.n_lines, r.n_removed) for r in out.collect()]
    assert sorted(mine, key=str) == brute_lines(rows, 3)


def test_blocks_and_buckets_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK_WINDOWS", 16)
    rows = corpus(5)
    block = windows._Block(5, 3, True)
    for i, t in rows[:20]:
        block.add(i, 0, substring_dedup.word_hashes(t.encode()))
    sent = list(block.flush())
    assert {s[0] for s in sent} <= {0, 1, 2} and any(s[-1] for s in sent)


def test_substring_empty_table(spark):
    assert substring_dedup.substring_dedup(frame(spark, []).limit(0)).count() == 0


def test_very_long_text_is_sliced():
    raw = b"ab cd\n" * 400_000
    assert len(substring_dedup.word_hashes(raw)) == 800_000
    assert b"".join(common.slices(raw, b" \n")) == raw
    solid = b"x" * (3 << 20)
    assert [len(p) for p in common.slices(solid, b" ")] == [len(solid)]


def brute_lines(rows, width):
    """First occurrences by id and position stay; rows with one id and text are one document."""
    order = sorted({((1 << 64) if i is None else i, t or "") for i, t in rows}, key=lambda r: (r[0], xxhash.xxh3_64_intdigest(r[1].encode())))
    seen, out = set(), {}
    for i, t in order:
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for k in range(len(full) - width + 1):
            key = tuple(lines[j].strip(" \t\n\x0b\x0c\r") for j in full[k : k + width])
            if key in seen:
                gone |= set(full[k : k + width])
            seen.add(key)
        out[i, t] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(full), len(gone))
    return sorted(((i, *out[(1 << 64) if i is None else i, t or ""]) for i, t in rows), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = [f"line {k}" for k in range(9)] + ["", "  ", " line 1 "]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 14)))) for i in range(40)]
    rows += [(50, None), (51, ""), rows[0], rows[0], (None, rows[4][1]), (52, "a\nb\nc\na\nb\nc"), (53, "a\nb")]
    out = line_dedup.line_dedup(frame(spark, rows))
    assert sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_removed) for r in out.collect()), key=str) == brute_lines(rows, 3)


def test_lines_carry_columns(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc", "en", None, 3), (2, "a\nb\nc", None, "s", 4), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n int")
    out = {r.doc_id: r for r in line_dedup.line_dedup(rows, carry=("lang", "source", "n")).collect()}
    assert (out[1].kept_text, out[1].lang, out[1].source, out[1].n) == ("a\nb\nc", "en", None, 3)
    assert (out[2].kept_text, out[2].lang, out[2].source, out[2].n) == ("", None, "s", 4)
    assert (out[3].kept_text, out[3].n) == ("", None)


def brute_print(text: str | None) -> int:
    words = [w.encode() for w in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = [t for _, t in corpus(7)] + ["One", "One two", "ONE TWO THREE", "É É É É"]
    rows = list(enumerate(texts))
    out = {r.doc_id: r.fp % (1 << 64) for r in simhash_dedup.fingerprints(frame(spark, rows)).collect()}
    assert out == {i: brute_print(t) for i, t in rows}
    whole = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert whole % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_anchors_cover():
    rng = np.random.default_rng(1)
    halves = rng.integers(0, 1 << 32, 200, dtype=np.uint64)
    for h in halves:
        _, own = simhash_dedup.anchors(np.array([h], np.uint64))
        assert len(set(own.tolist())) == len(own) and all(int(a ^ h).bit_count() <= 2 for a in own)
        for bit in range(32):  # a half one bit away shares an anchor
            _, other = simhash_dedup.anchors(np.array([h ^ np.uint64(1 << bit)], np.uint64))
            assert set(own.tolist()) & set(other.tolist())


def components(n, links):
    label = list(range(n))
    find = lambda x: x if label[x] == x else find(label[x])
    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("run", [8192, 3])
def test_near_links_are_complete(spark, monkeypatch, run):
    monkeypatch.setattr(simhash_dedup, "RUN", run)  # short runs are compared at once, long ones in pairs of blocks
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(160):
        p = rng.choice(prints)
        for _ in range(rng.randint(1, 4)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    prints = list(dict.fromkeys([0, *prints, (1 << 64) - 1]))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash_dedup.near_links(spark.createDataFrame(signed, "fp long").repartition(3))
    at = {p[0]: k for k, p in enumerate(signed)}
    found = [(at[r.a], at[r.b]) for r in edges.collect()]
    brute = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert components(len(prints), found) == components(len(prints), brute)


def test_simhash_of_whole_corpora_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    bases = [rng.choices(words, k=rng.randint(60, 200)) for _ in range(25)]
    texts = []
    for _ in range(220):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    rows = [(k * 7 % 225, t) for k, t in enumerate([*texts, None, "", "one", "one two"])]
    prints = [brute_print(t) for _, t in rows]
    label = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    least: dict[int, int] = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min(least.get(c, i), i)
    want = sorted((i, p, least[c]) for (i, _), p, c in zip(rows, prints, label, strict=True))
    got = sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash_dedup.simhash_dedup(frame(spark, rows).repartition(4)).collect())
    assert got == want and len(set(label)) < 0.7 * len(rows)


def test_simhash_groups(spark):
    rows = [(5, "a b c d"), (3, "A b C d"), (9, None), (7, ""), (None, "a b c d"), (None, "alone in the whole wide world"), (11, "nothing like the others at all here"), (11, "nothing like the others at all here")]
    out = simhash_dedup.simhash_dedup(frame(spark, rows))
    got = sorted(((r.doc_id, r.component_id) for r in out.collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 7), (7, 7), (None, 3), (None, None), (11, 11), (11, 11)], key=str)
    assert sorted(((r.doc_id, r.component_id) for r in out.collect() if r.kept), key=str) == sorted([(3, 3), (7, 7), (None, None), (11, 11), (11, 11)], key=str)
    assert simhash_dedup.simhash_dedup(frame(spark, []).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(90)] + [(300, 300)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components(301, links)
    assert out == {k: want[k] for k in {x for ab in links for x in ab} - {300}}
    assert connected_components(spark.createDataFrame([(None, 1)], "a long, b long")).count() == 0


def test_packed_numbers():
    for values in ([], [0], [0, 255, 256, 70000, 1 << 40], list(range(500))):
        assert common.unpack(common.pack(np.array(values, np.int64))).tolist() == values
