"""Quality rules: lines are judged first, then what is left of the document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .substring_dedup import word_hashes

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Phrases of boilerplate lines, lower case.
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "licensed under", "click here", "sign in", "log in", "subscribe to", "lorem ipsum", "enable javascript", "javascript is disabled", "share on")


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the document's loss.

    A line fails if (punctuation) it has at least ``bare_words`` words and does
    not end in one of ``ends``; if (navigation) more than ``most_marked`` percent
    of its words hold one of ``SYMBOLS``, or it shouts: at least ``least_upper``
    letters A-Z and more than ``upper_times`` times its letters a-z; if
    (boilerplate) it holds a boilerplate phrase.  The document fails if more than
    ``most_lost`` percent of its words stand in failing lines.
    """

    bare_words: int = 8
    ends: bytes = b".!?\"')]:;"
    most_marked: int = 30
    least_upper: int = 10
    upper_times: int = 3
    most_lost: int = 40


_MARKED = re.compile(rb"[^\x20\x09-\x0D]*[#*$%&|<>][^\x20\x09-\x0D]*")
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_LOWER = bytes(c for c in range(256) if not 97 <= c <= 122)


def line_fails(line: bytes, n_words: int, rules: LineRules) -> str:
    """The first rule that a stripped line with words fails, or ''."""
    if n_words >= rules.bare_words and line[-1] not in rules.ends:
        return "punctuation"
    if line.translate(None, SYMBOLS) != line and 100 * sum(1 for _ in _MARKED.finditer(line)) > rules.most_marked * n_words:
        return "navigation"
    upper = len(line.translate(None, _NOT_UPPER))
    if upper >= rules.least_upper and upper > rules.upper_times * len(line.translate(None, _NOT_LOWER)):
        return "navigation"
    return "boilerplate" if _BOILER.search(line.lower()) else ""


def repeated_words(h: np.ndarray, width: int = 3) -> int:
    """Words in ``width``-word windows that the text holds at least twice, from the words' hashes."""
    n = len(h) - width + 1
    if n < 2:
        return 0
    w = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            w = common.mix(w * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k])
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    mask = np.zeros(len(h), bool)
    for k in range(width):
        mask[k : n + k] |= twice
    return int(mask.sum())


_OUT = pa.schema([
    *((c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
    *((c, pa.int64()) for c in ("n_lost_words", "n_punctuation", "n_navigation", "n_boilerplate")), ("cleaned_text", pa.string()),
])
_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long, n_punctuation long, n_navigation long, n_boilerplate long, cleaned_text string"


def judge(raw: bytes, rules: LineRules) -> tuple:
    """The columns after doc_id for one text; of its words eight bytes each are held."""
    hashes = word_hashes(raw)
    n, seen, n_dup, lost, kept = len(hashes), set(), 0, 0, []
    failed = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    for line in raw.split(b"\n"):
        if not (own := line.strip(SPACE)):
            continue
        n_dup += line in seen
        seen.add(line)
        n_own = sum(len(piece.split()) for piece in common.slices(own, SPACE))
        if rule := line_fails(own, n_own, rules):
            failed[rule] += 1
            lost += n_own
        else:
            kept.append(line)
    repeat = repeated_words(hashes)
    bare = raw.translate(None, SPACE)
    chars = len(bare) if raw.isascii() else len(bare.decode())
    base_failed = n < 50 or 100 * repeat > 50 * n
    return n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), n_dup, repeat, base_failed, not base_failed and 100 * lost <= rules.most_lost * n, lost, *failed.values(), b"\n".join(kept).decode()


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Clean texts line by line and judge what is lost.

    Returns one row per input row: doc_id, the base counts n_words, word_chars,
    n_symbols, n_dup_lines (exact repeats of an earlier line with a word),
    n_repeat_words; base_failed (under 50 words, or over half of them in repeated
    three-word windows), kept (neither base_failed nor too much lost), how many
    words and lines failed by rule, and cleaned_text, the lines that passed.

    A null or empty text has no words and fails.  Blank lines are dropped from
    cleaned_text.  Null ids and repeated rows are kept, each with its row.  Other
    columns of ``docs`` are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc_id, *judge(raw, rules)) for doc_id, raw in common.texts(batches))
        return common.batches(rows, _OUT, 512)

    return common.id_and_text(docs, id_col, text_col).mapInArrow(work, _DDL)
