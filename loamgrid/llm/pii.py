"""Personal data by weak-supervision aggregation, in DataFrame functions alone.

Candidate spans come from strict patterns and from looser ones.  Four labelers
vote on each (for, against, or no vote): a regex labeler, a gazetteer labeler, a
context labeler and a boundary labeler.  Spark counts the vote patterns of all
documents; expectation-maximisation over these few counts estimates every
labeler's reliability for each kind and the probability of each pattern; a
logistic span classifier learns those probabilities and becomes a Column
expression.  Spans of the strict patterns always stay; the classifier decides on
the others.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")

# A run is entered at its start or where the last match ended, and never given
# back: the same matches as the plain patterns, in time that grows with the text.
_LOCAL = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser patterns; a card candidate is a strict match of 13 to 19 digits that fails Luhn.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?[(\[](?i:at)[)\]] ?[A-Za-z0-9-]{{1,63}}+(?: ?(?:\.|[(\[](?i:dot)[)\]]) ?[A-Za-z0-9-]{{1,63}}+){{1,6}}",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
#: Cheap tests that a text must pass before a pattern is run over it.
_FIRST = {
    "email": lambda t: F.instr(t, "@") > 0,
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike("[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: F.instr(t, "+") > 0,
}
_FIRST_LOOSE = {"email": lambda t: t.rlike(r"(?i)[(\[]at[)\]]"), "ip": lambda t: F.instr(t, "[.]") > 0, "phone": lambda t: t.rlike("[0-9]{3}[.-][0-9]{4}")}

# The gazetteers and context words.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "co", "info", "de", "fr", "es", "it", "uk", "eu")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|30|36|38|6011|64|65)"
LOCAL_NETS = r"^(?:0|10|127|255|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."
CALLING_CODES = r"^\+?(?:1|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
CUES = {
    "email": "mail|contact|write|reach|address|correo|adresse",
    "ip": "ip|host|server|address|client|login|from|adresse",
    "card": "card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|cell|fax|contact|telefon|movil",
}
AGAINST = "version|order|isbn|figure|serial|part no|item|invoice|token|hash"

#: Matches whose places are summed up together; a text's places cost time in proportion to its matches.
CHUNK = 512
_SPAN = "array<struct<start: int, end: int, hit: string, before: string, after: string>>"


def _matches(text: Column, pattern: str, first: Column) -> tuple[Column, Column]:
    """All matches, and of the stretches between them the size in code points, the end and the first character."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    around = F.transform(gaps, lambda g: F.struct(F.char_length(g).alias("size"), F.right(g, F.lit(28)).alias("before"), F.left(g, F.lit(1)).alias("after")))
    return F.when(first, hits), F.when(first, around)


def _rows(hits: Column, around: Column) -> Column:
    """A row for each match; none for a text without matches."""
    met = F.zip_with(hits, F.slice(around, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g["size"].alias("size"), g["before"].alias("before")))
    return F.when(F.size(hits) > 0, F.zip_with(met, F.slice(around, F.lit(2), F.size(hits)), lambda m, g: m.withField("after", g["after"])))


def _chunks(rows: Column, keep: Callable[[Column], Column]) -> Column:
    """For each CHUNK matches their length with the stretches before them, and the spans kept, from the chunk's start."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(state: Column, row: Column) -> Column:
        begin = state["at"] + row["size"]
        end = begin + F.char_length(row["hit"])
        span = F.struct(begin.alias("start"), end.alias("end"), row["hit"].alias("hit"), row["before"].alias("before"), row["after"].alias("after"))
        return F.struct(end.alias("at"), F.when(keep(row["hit"]), F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda k: F.aggregate(F.slice(rows, k * CHUNK + 1, F.lit(CHUNK)), none, step))


def _bases(chunks: Column) -> Column:
    """Where each chunk begins."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(chunks, none, lambda state, c: F.struct((state["at"] + c["at"]).alias("at"), F.array_append(state["out"], state["at"]).alias("out")))["out"]


def _spans(chunks: Column, bases: Column) -> Column:
    moved = F.zip_with(chunks, bases, lambda c, b: F.transform(c["out"], lambda s: s.withField("start", s["start"] + b).withField("end", s["end"] + b)))
    return F.coalesce(F.flatten(moved), F.array().cast(_SPAN))


def with_spans(rows: DataFrame, text: str, searches: Mapping[str, tuple[str, Callable, Callable]]) -> DataFrame:
    """Add a column of spans for each name's (pattern, cheap test of the text, test of a match).

    Places are code points.  Each step is a projection of its own: what it reads
    more than once must not be computed more than once.
    """
    own = rows.columns
    for name, (pattern, first, _) in searches.items():
        hits, around = _matches(F.col(text), pattern, first(F.col(text)))
        rows = rows.withColumns({f"__hits_{name}": hits, f"__around_{name}": around})
    columns = lambda make: [*own, *(make(name).alias(f"__{name}") for name in searches)]
    rows = rows.select(columns(lambda name: _rows(F.col(f"__hits_{name}"), F.col(f"__around_{name}"))))
    rows = rows.select(columns(lambda name: _chunks(F.col(f"__{name}"), searches[name][2])))
    rows = rows.select(*own, *(f"__{name}" for name in searches), *(_bases(F.col(f"__{name}")).alias(f"__base_{name}") for name in searches))
    return rows.select(*own, *(_spans(F.col(f"__{name}"), F.col(f"__base_{name}")).alias(name) for name in searches))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(turned, k, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _long_enough(kind: str, hit: Column) -> Column:
    if kind == "card":
        return F.char_length(_digits(hit)).between(13, 19)
    return F.char_length(_digits(hit)).between(9, 15) if kind == "phone" else F.lit(True)


def _valid(kind: str, hit: Column) -> Column:
    """Whether a strict match of the right length counts."""
    if kind == "ip":
        return hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    return _luhn(_digits(hit)) if kind == "card" else F.lit(True)


def votes(kind: str, span: Column, base: Column) -> list[Column]:
    """The labelers' votes (1, 0, -1) on a candidate span; ``base`` if the strict pattern found it and it counts."""
    hit, before, after = span["hit"], F.lower(span["before"]), F.coalesce(span["after"], F.lit(""))
    yes = lambda c: F.when(c, 1).otherwise(-1)
    regex = F.when(base, 1).otherwise(-1 if kind == "card" else 0)
    if kind == "email":
        gazetteer = yes(F.lower(hit).rlike(rf"[.)\]] ?(?:{'|'.join(DOMAINS)})$"))
    elif kind == "ip":
        gazetteer = yes(~F.replace(F.replace(hit, F.lit("["), F.lit("")), F.lit("]"), F.lit("")).rlike(LOCAL_NETS))
    elif kind == "card":
        gazetteer = yes(_digits(hit).rlike(ISSUERS))
    else:
        gazetteer = F.when(hit.startswith("+"), yes(hit.rlike(CALLING_CODES))).otherwise(yes(_digits(hit).rlike("^[2-9]")))
    context = F.when(before.rlike(rf"\b(?:{CUES[kind]})"), 1).when(before.rlike(rf"\b(?:{AGAINST})"), -1).otherwise(0)
    boundary = yes((before.rlike(r"(?:^|[\s(\[<\"':;,|])$")) & after.rlike(r"^(?:$|[\s)\]>\"':;,.!?|])"))
    return [regex, gazetteer, context, boundary]


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier by kind: one for each labeler's yes and no, and a bias."""

    weights: dict[str, list[float]]

    def score(self, kind: str, vote: list[Column]) -> Column:
        w = self.weights.get(kind)
        if w is None:
            return F.lit(0.0)
        total = F.lit(w[-1])
        for k, v in enumerate(vote):
            total = total + F.when(v == 1, w[2 * k]).when(v == -1, w[2 * k + 1]).otherwise(0.0)
        return total


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The probability that a candidate with each vote pattern is real.

    Labelers are taken as independent given the truth, each with its own rates of
    yes, no and no vote; they start out believed, the regex labeler most.
    """
    start = 1 / (1 + np.exp(-(patterns @ np.array([2.0, *[0.7] * (patterns.shape[1] - 1)]))))
    belief = start
    for _ in range(rounds):
        prior = (counts @ belief + 1) / (counts.sum() + 2)
        yes, no = np.full(len(belief), math.log(prior)), np.full(len(belief), math.log(1 - prior))
        for k in range(patterns.shape[1]):
            for value in (-1, 0, 1):
                there = patterns[:, k] == value
                a, b = counts[there] @ belief[there], counts[there] @ (1 - belief[there])
                yes[there] += math.log((a + 1 + (value == 1)) / (counts @ belief + 4))
                no[there] += math.log((b + 1 + (value == -1)) / (counts @ (1 - belief) + 4))
        belief = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
    return belief


def train_classifier(patterns: np.ndarray, counts: np.ndarray, belief: np.ndarray, steps: int = 400) -> list[float]:
    """Logistic regression on the votes towards the estimated probabilities."""
    x = np.concatenate([np.stack([patterns[:, k] == v for k in range(patterns.shape[1]) for v in (1, -1)], 1).astype(float), np.ones((len(patterns), 1))], 1)
    w, weight = np.zeros(x.shape[1]), counts / counts.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w += 2.0 * (x.T @ (weight * (belief - p)) - 1e-3 * w)
    return w.tolist()


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, email, ip, card, phone), one row per input row: each kind's candidate spans, by their places, with their votes.

    A span is struct<start, end, base, v0, v1, v2, v3>; ``base`` tells that the
    strict pattern found it and that it counts.  One pass over the texts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    searches = {f"strict_{kind}": (STRICT[kind], _FIRST[kind], lambda hit, kind=kind: _long_enough(kind, hit)) for kind in KINDS}
    searches |= {f"loose_{kind}": (pattern, _FIRST_LOOSE[kind], lambda hit: F.lit(True)) for kind, pattern in LOOSE.items()}
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), text.alias("__text")), "__text", searches)

    def judged(kind: str, s: Column, base: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), base.alias("base"), *(v.cast("int").alias(f"v{k}") for k, v in enumerate(votes(kind, s, base))))

    def both(kind: str) -> Column:
        strict = F.transform(F.col(f"strict_{kind}"), lambda s: judged(kind, s, _valid(kind, s["hit"])))
        if kind == "card":  # a match of the right length that fails Luhn is still a candidate
            return strict
        return F.array_sort(F.concat(F.filter(strict, lambda s: s["base"]), F.transform(F.col(f"loose_{kind}"), lambda s: judged(kind, s, F.lit(False)))))

    return found.select("doc_id", *(both(kind).alias(kind) for kind in KINDS))


def learn(found: DataFrame) -> SpanModel:
    """Count the vote patterns of all candidates and fit the span classifier.

    At most 3^4 patterns of a kind reach the driver.
    """
    cast = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), *(s[f"v{k}"].alias(f"v{k}") for k in range(4)))
    every = F.concat(*(F.transform(F.col(kind), cast(kind)) for kind in KINDS))
    counted = found.select(F.explode(every).alias("c")).groupBy("c").count().select("c.*", "count").collect()
    weights = {}
    for kind in KINDS:
        rows = sorted(tuple(r)[1:] for r in counted if r[0] == kind)
        if rows:
            patterns, counts = np.array([r[:-1] for r in rows]), np.array([r[-1] for r in rows], float)
            weights[kind] = train_classifier(patterns, counts, expectation_maximisation(patterns, counts))
    return SpanModel(weights)


def find_pii(docs: DataFrame, model: SpanModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every text: (doc_id, base, added, n_email, n_ip, n_card, n_phone), one row per input row.

    ``base`` and ``added`` are arrays of struct<kind, start, end>, in the order
    of KINDS and then of start; places are code points, the end exclusive.
    ``base`` are the strict patterns' spans that count; ``added`` those of the
    other candidates which the model (learned from ``docs`` if None) scores at
    one half or more and which meet no base span of their kind.  The texts are
    searched once: candidates and votes are written to the shared folder, then
    counted for the model and scored by it.

    A null or empty text has no spans.  Null ids and repeated rows are kept, each
    with its row.  Other columns of ``docs`` are not read.
    """
    found = common.written(candidates(docs, id_col, text_col))
    model = model or learn(found)
    plain = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    def met(kind: str, s: Column, k: Column) -> Column:
        # by digits and brackets a base span meets two others of its kind at most, so none stands further off in the order
        near = (F.get(kind, k + step) for step in (-2, -1, 1, 2))
        return functools.reduce(Column.__or__, (F.coalesce(b["base"] & (b["start"] < s["end"]) & (s["start"] < b["end"]), F.lit(False)) for b in near))

    def wanted(kind: str) -> Column:
        good = lambda s, k: ~s["base"] & (model.score(kind, [s[f"v{n}"] for n in range(4)]) >= 0) & ~met(kind, s, k)
        return F.transform(F.filter(kind, good), plain(kind))

    certain = {kind: F.filter(kind, lambda s: s["base"]) for kind in KINDS}
    base = F.concat(*(F.transform(spans, plain(kind)) for kind, spans in certain.items()))
    return found.select("doc_id", base.alias("base"), F.concat(*map(wanted, KINDS)).alias("added"), *(F.size(spans).cast("long").alias(f"n_{kind}") for kind, spans in certain.items()))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column) -> Column:
    """Spans by kind as listed, then start and end."""
    rank = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
