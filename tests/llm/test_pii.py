"""Personal data: strict spans against Python's own patterns, and the learned part."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute(text: str) -> list[str]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


CASES = [
    "", "mail a.b@c.de now", "a@b@c.de", "a@b.c_d@e.f", "x@y", "@a.b", "a@b..c", "é a@b.c é", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.0255", "4111 1111 1111 1111", "4111-1111-1111-1111x", "4111111111111112",
    "1" * 40, "+1 (234) 555-0199.", "+1234567", "+12", "++1 222 333 444", "+1-2+3 456 789 012", "😀 a@b.c 😀 1.2.3.4", "a@b.c" * 5, "4111 1111  1111 1111", "5 5 5 5", "a" * 3000 + "@b.c", "." * 2000, "1." * 1500, "1 " * 3000,
]


@pytest.fixture(scope="module")
def model():
    return pii.SpanModel({})


def test_strict_spans(spark, model):
    rng = random.Random(1)
    alphabet = ["a", "b1", "@", ".", "-", " ", "+", "(", ")", "4111111111111111", "12", "255", "é", "\n", "_", "7"]
    texts = CASES + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(1500)]
    frame = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, base string, kind string")
    out = pii.find_pii(frame, model)
    rows = {r.doc_id: r for r in out.select("doc_id", pii.joined(F.col("base")).alias("b"), *(f"n_{k}" for k in pii.KINDS)).collect()}
    for k, text in enumerate(texts):
        want = brute(text)
        assert rows[k].b == ",".join(want), text
        assert [rows[k][f"n_{kind}"] for kind in pii.KINDS] == [sum(w.startswith(kind) for w in want) for kind in pii.KINDS]


def test_places_of_more_matches_than_a_chunk_holds(spark, model, monkeypatch):
    monkeypatch.setattr(pii, "CHUNK", 3)
    test_strict_spans(spark, model)


def test_time_grows_with_the_text(spark, model):
    numbers = " x".join(str(k) for k in range(100_000, 300_000))
    cards = ", ".join(["4111 1111 1111 1111"] * 20_000)
    frame = spark.createDataFrame([(1, numbers + " x4111111111111111"), (2, cards), (3, "+1 234 567 8901; 234-567-8901; " * 20_000)], "doc_id long, text string")
    began = time.perf_counter()
    out = {r.doc_id: r for r in pii.find_pii(frame, model).collect()}
    assert time.perf_counter() - began < 60
    assert [(s.start, s.end) for s in out[1].base] == [(len(numbers) + 2, len(numbers) + 18)]
    assert out[2].n_card == 20_000 and out[2].base[-1].end == len(cards)
    assert out[3].n_phone == 20_000 and len(out[3].added) == 20_000


def found_by(pattern: str, text: str) -> list[tuple[int, int, int, str]]:
    """Matches with the end of the match before and the character after; none if another match follows at once."""
    at = [m.span() for m in re.finditer(pattern, text)]
    return [(a, b, gap, "" if b in {x for x, _ in at} else text[b : b + 1]) for (a, b), gap in zip(at, [0, *(b for _, b in at)], strict=False)]


def vote(kind: str, text: str, span: tuple[int, int, int, str], base: bool) -> tuple[int, ...]:
    """The labelers in plain Python."""
    start, end, gap, after = span
    hit, before = text[start:end], text[max(gap, start - 28) : start].lower()
    digits = re.sub("[^0-9]", "", hit)
    yes = lambda x: 1 if x else -1
    known = {
        "email": lambda: re.search(rf"[.)\]] ?(?:{'|'.join(pii.DOMAINS)})$", hit.lower()), "ip": lambda: not re.search(pii.LOCAL_NETS, hit.replace("[", "").replace("]", "")), "card": lambda: re.search(pii.ISSUERS, digits),
        "phone": lambda: re.search(pii.CALLING_CODES, hit) if hit[0] == "+" else digits[0] >= "2",
    }[kind]()
    context = 1 if re.search(rf"\b(?:{pii.CUES[kind]})", before) else -1 if re.search(rf"\b(?:{pii.AGAINST})", before) else 0
    apart = (not before or before[-1] in " \t\n([<\"':;,|") and (not after or after in " \t\n)]>\"':;,.!?|")
    return (1 if base else -1 if kind == "card" else 0), yes(known), context, yes(apart)


def brute_candidates(text: str) -> dict[str, list[tuple]]:
    """(start, end, base, votes) of each kind."""
    out = {}
    for kind in pii.KINDS:
        good = {s for s in brute(text) if s.startswith(kind)}
        rows = []
        for span in found_by("[0-9]+(?:[ -][0-9]+)*" if kind == "card" else BASE[kind], text):
            a, b = span[:2]
            base = f"{kind}:{a}:{b}" in good
            if base or kind == "card" and 13 <= len(re.sub("[^0-9]", "", text[a:b])) <= 19:
                rows.append((a, b, base, vote(kind, text, span, base)))
        if kind != "card":
            rows += [(*span[:2], False, vote(kind, text, span, False)) for span in found_by(pii.LOOSE[kind].replace("(?i:at)", "(?:[aA][tT])").replace("(?i:dot)", "(?:[dD][oO][tT])"), text)]
        out[kind] = sorted(rows)
    return out


def brute_spans(texts: list[str]) -> tuple[list[str], dict]:
    """All spans of each text, with the classifier learned from all of them."""
    found, weights = [brute_candidates(t) for t in texts], {}
    for kind in pii.KINDS:
        counts = Counter(v for f in found for *_, v in f[kind])
        if counts:
            patterns = sorted(counts)
            n = np.array([counts[p] for p in patterns], float)
            weights[kind] = pii.train_classifier(np.array(patterns), n, pii.expectation_maximisation(np.array(patterns), n))
    out = []
    for f in found:
        spans = []
        for kind in pii.KINDS:
            base = [r for r in f[kind] if r[2]]
            w = weights.get(kind)
            score = lambda v, w=w: w[-1] + sum(w[2 * k] if x == 1 else w[2 * k + 1] if x == -1 else 0 for k, x in enumerate(v))
            added = [r for r in f[kind] if not r[2] and score(r[3]) >= 0 and not any(b[0] < r[1] and r[0] < b[1] for b in base)]
            spans += [f"{kind}:{a}:{b}" for a, b, *_ in sorted(base + added)]
        out.append(",".join(spans))
    return out, weights


def test_all_spans_against_brute_force(spark):
    rng = random.Random(5)
    parts = [
        "mail jo@site.com", "write to jo (at) site.com", "jo[at]site [dot] org", "x@y.z(at)q.com", "10.0.0.1", "host 8.8.8.8,", "8[.]8[.]8[.]8", "1.2.3.4[.]5[.]6[.]7", "card 4111 1111 1111 1111", "4111111111111112", "order 9999 9999 9999 9999",
        "call 555-123-4567", "(555) 123-4567", "+1 234 567 8901", "+49 30 1234567 555-123-4567", "555-123-4567+15551234567", "version 1.2.3.4", "Tel: +331 23 45 67 89 10", "é ß", "serial 123-456-7890x",
    ]
    texts = [rng.choice([" ", ", ", "\n", ""]).join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want, weights = brute_spans(texts)
    model = pii.learn(pii.candidates(frame))
    assert {k: np.round(w, 6).tolist() for k, w in model.weights.items()} == {k: np.round(w, 6).tolist() for k, w in weights.items()}
    out = {r.doc_id: r.s for r in pii.find_pii(frame).select("doc_id", pii.joined(pii.in_order(F.concat("base", "added"))).alias("s")).collect()}
    assert [out[k] for k in range(len(texts))] == want and any(len(w.split(",")) > len(brute(t)) for w, t in zip(want, texts, strict=True))


def test_odd_rows(spark):
    frame = spark.createDataFrame([(1, None), (None, "a@b.com"), (2, "a@b.com"), (2, "a@b.com")], "doc_id long, text string")
    out = pii.find_pii(frame).select("doc_id", pii.joined(pii.in_order(F.concat("base", "added"))).alias("s")).collect()
    assert sorted(((r.doc_id, r.s) for r in out), key=str) == sorted([(1, ""), (None, "email:0:7"), (2, "email:0:7"), (2, "email:0:7")], key=str)
    assert pii.find_pii(frame.limit(0)).count() == 0


def test_the_model_adds_and_spares(spark):
    texts = [f"please call {200 + k}-555-01{k:02d} today" for k in range(40)] + [f"call me: +1 (202) 555-01{k:02d}" for k in range(40)] + [f"order no {k}00-111-2222x7" for k in range(1, 9)]
    texts += [f"write to jo{k} (at) mail.com" for k in range(30)] + [f"write to jo{k}@mail.com" for k in range(30)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.added for r in pii.find_pii(frame).collect()}
    assert sum(len(out[k]) for k in range(40)) >= 36  # phones without a plus sign
    assert not any(out[k] for k in range(40, 80))  # base spans are not added again
    assert sum(len(out[k]) for k in range(88, 118)) >= 27
    assert [(s.kind, texts[0][s.start : s.end]) for s in out[0]] == [("phone", "200-555-0100")]


def test_expectation_maximisation_finds_the_reliable_labelers():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.85, 0.75, 0.6])
    votes = np.where(rng.random((4000, 4)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    belief = pii.expectation_maximisation(patterns, counts.astype(float))
    assert ((belief[inverse.ravel()] > 0.5) == truth).mean() > 0.93
    weights = pii.train_classifier(patterns, counts.astype(float), belief)
    assert weights[0] - weights[1] > weights[6] - weights[7] > 0
