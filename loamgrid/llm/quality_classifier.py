"""A quality classifier learned from positive and unlabelled documents.

With class prior p and the squared loss l the non-negative unbiased risk is
    R = p * mean_P l(g, +1) + max(0, mean_U l(g, -1) - p * mean_P l(g, -1)).
The score function g is linear in a fixed set of basis functions of a text's
features, so R and its gradient depend on the data through the bases' means and
second moments alone.  Spark sums those up over all trusted positives and all
unlabelled documents; no sample is drawn, and fitting costs the same at any size.
The minimiser of the squared loss is 2 P(y = 1 | x) - 1, which makes a score.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid import lineage

from . import common

#: Quantiles of every feature, over all documents, between which its ramps rise.
QUANTILES = (0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.13, 0.16, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.84, 0.87, 0.9, 0.92, 0.94, 0.96, 0.98, 0.99)
#: Numbers of a moment matrix that travel in one row, and groups of workers whose matrices are summed first.
CHUNK = 2048
SUMMED = 256
#: The prior of the models whose scores estimate it, and the ranges into which those are counted.
START = 0.5
STEPS = 256
SPACE = b" \t\n\x0b\x0c\r"

_SYMBOLS = b"#*$%&|<>{}[]\\^~=_@"
_UPPER, _LOWER, _DIGITS = (bytes(c for c in range(256) if not a <= c <= b) for a, b in ((65, 90), (97, 122), (48, 57)))
_NOT_HIGH = bytes(range(128))
N_FEATURES = 22


@dataclass(frozen=True)
class WordStats:
    """How many words, different words, uses of the commonest, words like the one before, words that end a sentence and different pairs."""

    n: int
    different: int
    top: int
    same: int
    ended: int
    pairs: int

    @classmethod
    def of(cls, raw: bytes) -> WordStats:
        if len(raw) > common.SLICE_BYTES:
            return cls._of_long(raw)
        words = raw.split()
        count = Counter(words)
        top = count.most_common(1)[0][1] if words else 0
        return cls(len(words), len(count), top, sum(map(bytes.__eq__, words, words[1:])), sum(1 for w in words if w[-1] in b".!?"), len(set(zip(words, words[1:], strict=False))))

    @classmethod
    def _of_long(cls, raw: bytes) -> WordStats:
        """The same from eight bytes a word: a slice's words are held at a time."""
        parts, ended = [], 0
        for piece in common.slices(raw, SPACE):
            words = piece.split()
            ended += sum(1 for w in words if w[-1] in b".!?")
            parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        h = np.concatenate(parts)
        counts = np.unique(h, return_counts=True)[1]
        with np.errstate(over="ignore"):
            pairs = common.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        return cls(len(h), len(counts), int(counts.max(initial=0)), int((h[1:] == h[:-1]).sum()), ended, len(np.unique(pairs)))


def features(raw: bytes) -> list[float]:
    """What a score may see of a text: its form, never its label, language, source or id."""
    all_words = WordStats.of(raw)
    n, size = max(1, all_words.n), max(1, len(raw))
    n_upper, n_lower = len(raw.translate(None, _UPPER)), len(raw.translate(None, _LOWER))
    worst = [0.0, 0.0, 0.0, 0.0]
    lines = raw.split(b"\n")
    shown = bad_words = n_ended = 0
    for line in lines:
        if not (own := line.rstrip(SPACE)):
            continue
        shown += 1
        if len(line) > common.SLICE_BYTES:
            stats = WordStats.of(line)
            k, different = stats.n, stats.different
        else:
            words = own.split()
            k, different = len(words), len(set(words))
        n_ended += own[-1] in b".!?:\"'"
        symbols = (len(line) - len(line.translate(None, _SYMBOLS))) / k
        up, low = len(line.translate(None, _UPPER)), len(line.translate(None, _LOWER))
        bangs, dull = line.count(b"!") / k, 1 - different / k
        shout = up / max(1, up + low)
        bad_words += k * (symbols > 0.5 or (k > 4 and (shout > 0.6 or bangs > 0.5 or dull > 0.6)))
        if k >= 5:
            worst = [max(a, b) for a, b in zip(worst, (min(symbols, 3), shout, min(bangs, 3), dull), strict=True)]
    return [
        math.log1p(all_words.n), min(3.0, (size - len(raw.translate(None, _SYMBOLS))) / n), min(3.0, raw.count(b"!") / n), n_upper / max(1, n_upper + n_lower), all_words.different / n, all_words.top / n,
        min(20.0, size / n), all_words.ended / n, len(raw.translate(None, _DIGITS)) / size, math.log1p(shown), n_ended / max(1, shown), all_words.same / n, len(raw.translate(None, _NOT_HIGH)) / size, all_words.pairs / n,
        *worst, bad_words / n, 1 - len(set(lines)) / max(1, len(lines)), float(all_words.n < 20), float(not all_words.n),
    ]


@dataclass(frozen=True)
class Basis:
    """One constant and, for every feature, ramps from 0 to 1 between its neighbouring quantiles."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, quantiles: list[list[float]]) -> Basis:
        ramps = []
        for k, values in enumerate(quantiles):
            edges = np.unique(np.asarray(values, float))
            # a feature that is almost always the same still tells apart what lies above it
            ramps += [(k, a, b) for a, b in zip(edges, edges[1:], strict=False)] or [(k, edges[0], edges[0] + 1e-3)]
        feature, low, high = zip(*ramps, strict=True)
        return cls(np.array(feature), np.array(low), np.array(high))

    @property
    def size(self) -> int:
        return 1 + len(self.feature)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rise = np.clip((x[:, self.feature] - self.low) / (self.high - self.low), 0, 1)
        return np.concatenate([np.ones((len(x), 1)), rise], 1)


@dataclass(frozen=True)
class Model:
    """Bases, their weights and the estimated class prior."""

    basis: Basis
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip((self.basis(x) @ self.weights + 1) / 2, 0, 1)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior, from how many positives and unlabelled rows score in each of STEPS equal ranges.

    Where only good documents score, the unlabelled are to the positives as the
    prior is to one, and anywhere else they are more.  So the least ratio of
    shares at or above a threshold estimates the prior; thresholds keep at least
    nine tenths of the positives, and one standard error is added to either share.
    The scores must come from a model that has not seen the rows.
    """
    above = lambda counts: np.cumsum(counts[::-1])[::-1] / max(1, counts.sum())
    p, u = above(positive), above(unlabelled)
    error = lambda share, counts: np.sqrt(share * (1 - share) / max(1, counts.sum()))
    kept = p >= 0.9
    ratio = (u + error(u, unlabelled))[kept] / (p - error(p, positive))[kept]
    return float(np.clip(ratio.min(), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 4000, decay: float = 5e-3) -> np.ndarray:
    """The weights that minimise the non-negative risk, from both classes' second moments.

    The first basis is the constant one, so that a moment's first row is the mean.
    It starts from the unbiased risk's minimiser.  Where the second part of the risk
    is negative its gradient is followed back, as the non-negative risk asks for;
    the weights of least risk seen are kept.
    """
    n = len(positive)
    ridge = decay * np.eye(n)
    ridge[0, 0] = 0
    # unbiased: p/4 mean_P[(1-g)^2 - (1+g)^2] + 1/4 mean_U (1+g)^2 = -p w.m_P + (1 + 2 w.m_U + w S_U w) / 4
    w = np.linalg.solve(unlabelled / 2 + 2 * ridge + 1e-9 * np.eye(n), prior * positive[0] - unlabelled[0] / 2)
    mean = lambda moment, sign: (1 + sign * 2 * (moment[0] @ w) + w @ moment @ w) / 4
    slope = lambda moment, sign: (sign * moment[0] + moment @ w) / 2
    rate = 0.5 / np.linalg.eigvalsh(unlabelled + prior * positive + 4 * ridge)[-1]
    best, least = w, math.inf
    for _ in range(steps):
        below = mean(unlabelled, 1) - prior * mean(positive, 1)
        risk = prior * mean(positive, -1) + max(0.0, below) + w @ ridge @ w
        if risk < least:
            best, least = w, risk
        second = slope(unlabelled, 1) - prior * slope(positive, 1)
        w = w - rate * ((prior * slope(positive, -1) + second if below >= 0 else -second) + 2 * ridge @ w)
    return best


def _bucket(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, x) of every document row: the one pass over the texts that training and scoring need.

    With ``carry``, column names among which is ``text_col``, those follow under
    their own names and the id is named __id.
    """
    own = "__id" if carry else "doc_id"
    rows = docs.select(F.col(id_col).cast("long").alias(own), *(carry or [F.col(text_col).cast("string").alias("text")]))
    at = 1 + (list(carry).index(text_col) if carry else 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                x = pa.array([features(raw or b"") for raw in part.column(at).cast(pa.binary()).to_pylist()], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.columns[1:] if carry else ()), x], [own, *carry, "x"])

    return rows.mapInArrow(work, ", ".join([f"{own} long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "x array<float>"]))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(np.float64)


def moments(rows: DataFrame, basis: Basis) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """Number and mean second moments of the bases for each (known, fold), over all rows (known, fold, x).

    A worker sends one matrix; matrices are summed in two levels, so that no task
    takes one from every worker.
    """
    upper = np.triu_indices(basis.size)
    schema = pa.schema([("known", pa.int32()), ("fold", pa.int32()), ("chunk", pa.int32()), ("total", pa.list_(pa.float64()))])
    ddl = "known int, fold int, chunk int, total array<double>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            keys, bases = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1), basis(_matrix(batch.column(2)))
            for value in map(tuple, np.unique(keys, axis=0).tolist()):
                own = bases[(keys == value).all(1)]
                sums[value] = sums.get(value, 0) + own.T @ own
        rows_ = ((*value, k // CHUNK, flat[k : k + CHUNK]) for value, total in sums.items() for flat in (total[upper],) for k in range(0, len(flat), CHUNK))
        return common.batches(rows_, schema, 16)

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.asarray(v) for batch in group.to_batches(16) for v in batch.column("total").to_pylist())
        return pa.Table.from_pylist([{"known": group["known"][0].as_py(), "fold": group["fold"][0].as_py(), "chunk": group["chunk"][0].as_py(), "total": total}], schema)

    parts = rows.select(F.col("known").cast("int"), F.col("fold").cast("int"), "x").mapInArrow(work, ddl).withColumn("worker", F.spark_partition_id() % SUMMED)
    once = parts.groupBy("known", "fold", "chunk", "worker").applyInArrow(add, ddl)
    found: dict[tuple[int, int], dict[int, list[float]]] = {}
    for r in once.groupBy("known", "fold", "chunk").applyInArrow(add, ddl).collect():
        found.setdefault((r["known"], r["fold"]), {})[r["chunk"]] = r["total"]
    out = {}
    for value, chunks in found.items():
        full = np.zeros((basis.size, basis.size))
        full[upper] = np.concatenate([chunks[k] for k in sorted(chunks)])
        full = full + full.T - np.diag(np.diag(full))
        out[value] = round(full[0, 0]), full / full[0, 0]
    return out


def _pooled(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    n = sum(k for k, _ in parts)
    return n, sum(k * m for k, m in parts) / n


def _fitted(basis: Basis, positive: tuple[int, np.ndarray], unlabelled: tuple[int, np.ndarray], prior: float) -> Model:
    decay = 3e-3 + 0.015 * basis.size / min(positive[0], unlabelled[0])  # what few rows cannot tell is held back
    return Model(basis, fit(positive[1], unlabelled[1], prior, decay=decay), prior)


def _scored(model: Model | None):
    """The score as a function of the column x."""

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(np.full(len(x), 0.5) if model is None else model.score(_matrix(x)))

    return score


def score_counts(rows: DataFrame, models: dict[int, Model]) -> dict[int, np.ndarray]:
    """For each value of known how many rows score in each of STEPS ranges; a row of fold f is scored by ``models[f]``."""
    score = functools.reduce(lambda rest, f: F.when(F.col("fold") == f, _scored(models[f])("x")).otherwise(rest), models, F.lit(0.0))
    counted = rows.withColumn("step", F.least(F.floor(score * STEPS), F.lit(STEPS - 1)).cast("int")).groupBy("known", "step").count().collect()
    out = {value: np.zeros(STEPS) for value in (0, 1)}
    for r in counted:
        out[r["known"]][r["step"]] = r["count"]
    return out


def train(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model | None:
    """Fit the model on all rows of a feature table that are labelled 1 and all without a label.

    Labels of rows whose crc32(id) mod 5 is 0 are held out: those rows are neither.
    A document with several labels is trusted only if all are 1; labels of 0 serve
    for nothing but to tell that a row is not unlabelled.  The class prior is
    estimated from the scores that each half of the rows gets from a model of the
    other half.  None if there is no positive or no unlabelled row.
    """
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("l_id")).agg(F.min(label_col).alias("y"))
    marks = marks.withColumn("learn", _bucket("l_id") != 0)
    known = F.when(F.col("l_id").isNull(), 0).when(F.col("learn") & (F.col("y") == 1), 1)
    rows = table.join(marks, F.col("doc_id") == F.col("l_id"), "left").select(known.alias("known"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold"), "x").filter("known IS NOT NULL")
    quantiles = table.agg(*(F.percentile_approx(F.col("x")[k], list(QUANTILES)).alias(f"q{k}") for k in range(N_FEATURES))).first()
    if quantiles[0] is None:
        return None
    basis = Basis.of([list(q) for q in quantiles])
    with lineage.scope():
        rows = common.written(rows)
        found = moments(rows, basis)
        part = {value: [found[value, f] for f in (0, 1) if (value, f) in found] for value in (0, 1)}
        if not part[0] or not part[1]:
            return None
        both = {f: all((value, 1 - f) in found for value in (0, 1)) for f in (0, 1)}  # else a model of all rows stands in
        models = {f: _fitted(basis, *((found[value, 1 - f] if both[f] else _pooled(part[value])) for value in (1, 0)), START) for f in (0, 1)}
        counts = score_counts(rows, models)
    return _fitted(basis, _pooled(part[1]), _pooled(part[0]), estimated_prior(counts[1], counts[0]))


def score_quality(table: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each of a feature table.

    ``held_out`` tells that crc32(id as text) mod 5 is 0; a null id is not held
    out.  ``score`` is the probability of label 1; ``predicted`` is 1 from
    ``threshold`` on.  A null text is empty; empty texts are scored too.  Without
    a model (nothing to learn from) every score is 0.5.  Rows that repeat get a
    row each.
    """
    out = table.select("doc_id", _scored(model)("x").alias("score"))
    held_out = F.coalesce(_bucket("doc_id") == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(table: DataFrame, model: Model | None, columns: list[str], threshold: float = 0.3) -> DataFrame:
    """The rows of a feature table scored at ``threshold`` or more, with ``columns`` alone and no shuffle."""
    return table.filter(_scored(model)("x") >= threshold).select(*columns)
