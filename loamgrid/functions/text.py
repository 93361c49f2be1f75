"""Text functions as Column expressions: search, count, replace, case, encode."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.errors import DataError

# The patterns behind the search tags.
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_URL = r"\b(?:https?://|ftp://|www\.)[^\s<>'\"\\)\]]+"
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
_HEX4 = "[A-Fa-f0-9]{1,4}"
_IPV6 = r"\b(?:" + "|".join([
    rf"(?:{_HEX4}:){{7}}{_HEX4}",
    rf"(?:{_HEX4}:){{1,7}}:",
    rf"(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,1}}",
    rf"(?:{_HEX4}:){{1,5}}(?::{_HEX4}){{1,2}}",
    rf"(?:{_HEX4}:){{1,4}}(?::{_HEX4}){{1,3}}",
    rf"(?:{_HEX4}:){{1,3}}(?::{_HEX4}){{1,4}}",
    rf"(?:{_HEX4}:){{1,2}}(?::{_HEX4}){{1,5}}",
    rf"{_HEX4}:(?:(?::{_HEX4}){{1,6}})",
    rf":(?:(?::{_HEX4}){{1,7}}|:)",
]) + r")\b"
_PHONE = r"\b(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{4}\b"
_ZIP = r"\b\d{5}(?:-\d{4})?\b"
_POSTAL = r"\b(?:\d{5}(?:-\d{4})?|[A-Za-z]\d[A-Za-z][ -]?\d[A-Za-z]\d|[A-Za-z]{1,2}\d[A-Za-z\d]?\s?\d[A-Za-z]{2})\b"
_DATE = rf"\b(?:\d{{4}}[-/]\d{{2}}[-/]\d{{2}}|\d{{2}}[-/]\d{{2}}[-/]\d{{4}}|{_MONTH}\s+\d{{1,2}},?\s+\d{{4}})\b"
_TIME = r"\b(?:[01]?\d|2[0-3]):[0-5]\d(?:[:][0-5]\d)?(?:\s?[APap][Mm])?\b"
_UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b"
_MAC = r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"

PATTERNS = {"url": _URL, "email": _EMAIL, "ip": f"(?:{_IPV4}|{_IPV6})", "ipv4": _IPV4, "ipv6": _IPV6, "phone": _PHONE, "zip": _ZIP, "postal": _POSTAL, "date": _DATE, "time": _TIME, "uuid": _UUID, "mac": _MAC}
ALIASES = {"link": "url", "mobile": "phone", "zip-code": "zip", "zipcode": "zip", "postal-code": "postal", "postalcode": "postal"}

_ANSI = r"\x1B\[[0-?]*[ -/]*[@-~]"

# Digits, letters and punctuation of the two target languages.
FA_DIGITS, AR_DIGITS, EN_DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩", "0123456789"
AR_LETTERS, FA_LETTERS = "يىئكةؤأإٱ", "یییکهوااا"
DASHES, KASHIDA = "–—‑−", "ـ"
_NUMBERED = 0x10000  # a rule's number is looked up as a character beyond this one
TRANSLATIONS = {
    "en": (FA_DIGITS + AR_DIGITS + "؟،؛٪٫٬" + DASHES + KASHIDA, EN_DIGITS * 2 + "?,;%.," + "-" * len(DASHES) + "_"),
    "fa": (EN_DIGITS + AR_DIGITS + AR_LETTERS + "?,;%" + "-_" + DASHES, FA_DIGITS * 2 + FA_LETTERS + "؟،؛٪" + KASHIDA * (2 + len(DASHES))),
}


def tag_patterns(tags: Iterable[str]) -> list[str]:
    """The patterns of tag names, case aside; an unknown name is an error."""
    names = [t.strip().lower() for t in tags if t.strip()]
    if unknown := [t for t in names if ALIASES.get(t, t) not in PATTERNS]:
        raise DataError(f"Unknown tag(s): {', '.join(unknown)}. Available tags: {', '.join(sorted([*PATTERNS, *ALIASES]))}.")
    return [PATTERNS[ALIASES.get(t, t)] for t in names]


def search_pattern(query: str | None = None, tags: Iterable[str] = (), regex: bool = False, ignore_case: bool = False, whole_word: bool = False) -> str:
    """One Java pattern for a query, literal unless ``regex``, and any tags."""
    parts = []
    if query:
        own = query if regex else java_quote(query)
        parts.append(rf"\b{own}\b" if whole_word else own)
    parts += tag_patterns(tags)
    if not parts:
        raise DataError("A query or a tag is required.")
    if regex and query:
        try:
            re.compile(query)
        except re.error as error:
            raise DataError(f"Invalid search pattern: {error}") from error
    return ("(?Uim)" if ignore_case else "(?Um)") + "|".join(f"(?:{p})" for p in parts)


def java_quote(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#" else c for c in text)


def count_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def lines_of(text: Column) -> Column:
    """Lines; a final line feed ends the last line instead of opening another."""
    return F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)


def line_hits(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """(id, line_no, line, n, found) for every line with a match, in one pass and without a shuffle."""
    rows = docs.filter(F.col(text_col).rlike(pattern)).select(id_col, F.posexplode(lines_of(F.col(text_col))).alias("k", "line"))
    found = rows.withColumn("found", matches(F.col("line"), pattern)).filter(F.size("found") > 0)
    return found.select(id_col, (F.col("k") + 1).cast("long").alias("line_no"), "line", F.size("found").cast("long").alias("n"), "found")


def search_stats(docs: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """One row: texts scanned, texts with a match, matches."""
    n = count_matches(F.col(text_col), pattern)
    return docs.select(n.alias("n")).agg(F.count("*").alias("scanned"), F.count_if(F.col("n") > 0).alias("matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("matches"))


def text_counts(text: Column) -> dict[str, Column]:
    """lines, words, characters, characters_no_spaces and bytes of a text."""
    return {
        "lines": F.when(text == "", 0).otherwise(F.size(lines_of(text))).cast("long"), "words": F.regexp_count(text, F.lit(r"(?U)\b[\w'-]+\b")).cast("long"), "characters": F.char_length(text).cast("long"),
        "characters_no_spaces": F.char_length(F.regexp_replace(text, r"(?U)\s", "")).cast("long"), "bytes": F.octet_length(text).cast("long"),
    }


def top_words(docs: DataFrame, text_col: str, n: int, word: str = r"(?U)\b[\w'-]+\b") -> DataFrame:
    """The ``n`` most frequent lower-cased words; of equal ones the smaller comes first."""
    words = docs.select(F.explode(matches(F.lower(F.col(text_col)), word)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "word").limit(n)


def replace_text(text: Column, find: str, put: str, regex: bool = False, ignore_case: bool = False) -> tuple[Column, Column]:
    """(new text, number of replacements); ``\\1`` refers to a group if ``regex``, a literal has no references."""
    if not regex and not ignore_case:
        return F.replace(text, F.lit(find), F.lit(put)), count_matches(text, java_quote(find))
    pattern = ("(?Ui)" if ignore_case else "(?U)") + (find if regex else java_quote(find))
    put = put.replace("$", r"\$")
    put = re.sub(r"\\g<(\w+)>", lambda m: "$" + m[1] if m[1].isdigit() else "${" + m[1] + "}", re.sub(r"\\(\d)", r"$\1", put)) if regex else put.replace("\\", "\\\\").replace("\\\\$", "\\$")
    return F.regexp_replace(text, pattern, put), count_matches(text, pattern)


# Macros of the batch find-and-replace.
MACROS = {"<UUID4>": r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", "<DOMAIN_PORT>": r"[a-zA-Z0-9.-]+:\d+"}


def expand_macros(pattern: str) -> str:
    for name, value in MACROS.items():
        pattern = pattern.replace(name, value)
    return re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, _ANSI, "")


def translate_text(text: Column, language: str) -> Column:
    """Digits, letters and punctuation in their English or Persian form."""
    if language.lower() not in TRANSLATIONS:
        raise DataError("Invalid destination language. Use 'en' or 'fa'.")
    return F.translate(text, *TRANSLATIONS[language.lower()])


def parse_rules(text: str) -> dict[int, str]:
    """Normalisation rules: a line is a character, a tab and what replaces it (nothing: delete)."""
    rules = {}
    for line in text.split("\n"):
        left, _, right = line.partition("\t")
        if len(left) == 1:
            rules[ord(left)] = right
    return rules


def default_rules() -> dict[int, str]:
    """Rules made from Unicode decompositions: Latin letters lose their marks, presentation forms unfold; hyphens go."""
    rules = {ord("-"): ""}
    for first, last in ((0xA1, 0x24F), (0x1E00, 0x1EFF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0xFF01, 0xFF5E)):
        for code in range(first, last + 1):
            plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
            if plain and plain != chr(code):
                rules[code] = plain
    rules |= {ord(a): b for a, b in zip(AR_LETTERS + AR_DIGITS, FA_LETTERS + FA_DIGITS, strict=True)}
    return rules | {ord(a): b for a, b in {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ł": "l", "Ł": "L", "«": "<<", "»": ">>", "©": "(C)", "®": "(R)"}.items()}


def _class_of(keys: Iterable[int]) -> str:
    """A Java character class; keys far apart stand behind ranges of their own, so that another character fails after a few tests."""
    groups: list[list[list[int]]] = []
    for key in sorted(keys):
        if not groups or key - groups[-1][-1][1] > 256:
            groups.append([[key, key]])
        elif key == groups[-1][-1][1] + 1:
            groups[-1][-1][1] = key
        else:
            groups[-1].append([key, key])
    shown = lambda low, high: rf"\x{{{low:X}}}-\x{{{high:X}}}"
    inner = "".join(f"[{shown(g[0][0], g[-1][1])}&&[{''.join(shown(*r) for r in g)}]]" for g in groups)
    return f"[{shown(groups[0][0][0], groups[-1][-1][1])}&&[{inner}]]"


def normalize_text(text: Column, rules: Mapping[int, str] | None = None) -> Column:
    """Replace characters by rules, all at once: ``translate`` does those of one character, and a text is only cut where others stand."""
    table = dict(default_rules() if rules is None else rules)
    many = {k: v for k, v in table.items() if len(v) > 1 or v == "\0"}  # translate takes U+0000 for a deletion
    ones = sorted(table.keys() - many.keys(), key=lambda k: not table[k])  # those to be deleted come last, they have no counterpart
    plain = lambda part: F.translate(part, "".join(map(chr, ones)), "".join(table[k] for k in ones)) if ones else part
    if not many:
        return plain(text)
    pattern, targets = _class_of(many), F.from_json(F.lit(json.dumps(list(many.values()))), "array<string>")
    numbers = "".join(chr(_NUMBERED + k) for k in range(1, len(many) + 1))
    target = lambda hit: F.element_at(targets, F.ascii(F.translate(hit, "".join(map(chr, many)), numbers)) - _NUMBERED)
    cut = F.zip_with(F.split(text, pattern, -1), matches(text, pattern), lambda gap, hit: F.concat(plain(gap), F.when(hit.isNull(), "").otherwise(target(hit))))
    return F.when(text.rlike(pattern), F.array_join(cut, "")).otherwise(plain(text))


# --- case -------------------------------------------------------------------------------------------------------------


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)[\s_\-]+"), lambda w: w != "")


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(word.substr(F.lit(2), F.char_length(word))))


def snake_case(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1_$2"), r"(?U)[\s-]+", "_"))


def kebab_case(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1-$2"), r"(?U)[\s_]+", "-"))


def pascal_case(text: Column) -> Column:
    return F.array_join(F.transform(_words(text), _capital), "")


def camel_case(text: Column) -> Column:
    return F.array_join(F.transform(_words(text), lambda w, k: F.when(k == 0, F.lower(w)).otherwise(_capital(w))), "")


def title_case(text: Column) -> Column:
    """The first letter of each word upper-cased, the rest lower-cased, separators kept."""
    pattern = r"(?U)\b[\w']+"
    words, gaps = matches(text, pattern), F.split(text, pattern, -1)
    return F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, F.when(w.isNull(), "").otherwise(_capital(w)))), "")


@functools.cache
def ascii_rules() -> dict[int, str]:
    """The ASCII letters in the compatibility decomposition of each character that has some."""
    plain = {code: unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode() for code in range(0x80, 0x110000)}
    return {code: letters for code, letters in plain.items() if letters}


def slugify(text: Column, allow_unicode: bool = False) -> Column:
    """A URL slug; characters beyond ASCII become the ASCII letters of their decomposition or go unless ``allow_unicode``."""
    # white space around the text ends as hyphens; without (?U) what is not a word, space or hyphen includes all beyond ASCII
    value, flag = (F.lower(text), "(?U)") if allow_unicode else (normalize_text(text, ascii_rules()), "")
    value = F.regexp_replace(F.regexp_replace(value, flag + r"[^\w\s-]+", ""), flag + r"[\s_-]+", "-")
    value = F.regexp_replace(value, "^-+|-+$", "")
    return value if allow_unicode else F.lower(value)


CASES = {"lower": F.lower, "upper": F.upper, "title": title_case, "snake": snake_case, "kebab": kebab_case, "camel": camel_case, "pascal": pascal_case, "slug": slugify, "slug-unicode": lambda c: slugify(c, True)}


def convert_case(text: Column, style: str, per_line: bool = False) -> Column:
    if style.lower() not in CASES:
        raise DataError(f"Unknown case {style!r}. Known: {', '.join(sorted(CASES))}.")
    convert = CASES[style.lower()]
    if per_line and style.lower() != "slug":
        return F.array_join(F.transform(lines_of(text), lambda line: convert(line)), "\n")
    return convert(text)


# --- encodings --------------------------------------------------------------------------------------------------------

_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_ROTATED = _ALPHABET[13:] + _ALPHABET[:13]


def _rot13(text: Column) -> Column:
    return F.translate(text, _ALPHABET + _ALPHABET.upper(), _ROTATED + _ROTATED.upper())


def _padded(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.char_length(bare), F.lit(4)).cast("int")))


def encode(text: Column, scheme: str) -> Column:
    """base64, base64url, hex, url, url-plus or rot13 of the text's UTF-8."""
    quoted = F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    base64 = F.translate(F.base64(text.cast("binary")), "\r\n", "")
    known = {"base64": base64, "base64url": F.translate(base64, "+/", "-_"), "hex": F.lower(F.hex(text.cast("binary"))), "url": F.replace(quoted, F.lit("+"), F.lit("%20")), "url-plus": quoted, "rot13": _rot13(text)}
    if scheme.lower() not in known:
        raise DataError(f"Unknown encoding: {scheme}")
    return known[scheme.lower()]


def decode(text: Column, scheme: str) -> Column:
    """The inverse of ``encode``; null where the text is not in the scheme, bytes that are not UTF-8 replaced by U+FFFD."""
    utf8 = lambda raw: F.make_valid_utf8(raw.cast("string"))
    known = {
        "base64": utf8(F.try_to_binary(_padded(text), F.lit("base64"))), "base64url": utf8(F.try_to_binary(_padded(F.translate(text, "-_", "+/")), F.lit("base64"))),
        "hex": utf8(F.try_to_binary(F.regexp_replace(text, r"\s+", ""), F.lit("hex"))), "url": F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), "url-plus": F.try_url_decode(text), "rot13": _rot13(text),
    }
    if scheme.lower() not in known:
        raise DataError(f"Unknown encoding: {scheme}")
    return known[scheme.lower()]


# --- small ones -------------------------------------------------------------------------------------------------------


def human_bytes(size: Column) -> Column:
    """A byte count with one decimal in the largest unit below 1024."""
    units, out = ["B", "KB", "MB", "GB", "TB", "PB"], None
    for k, unit in reversed(list(enumerate(units))):
        text = F.format_string(f"%.1f {unit}", size.cast("double") / float(1024**k))
        out = text if out is None else F.when(F.abs(size) < 1024 ** (k + 1), text).otherwise(out)
    return out


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]])", r"\\$1")


def emphasis(text: Column, marker: str) -> Column:
    """Markers that hug the text, spaces left outside; nothing around blank text."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(bare == "", text).otherwise(F.concat(F.regexp_extract(text, r"(?U)^\s*", 0), F.lit(marker), bare, F.lit(marker), F.regexp_extract(text, r"(?U)\s*$", 0)))


def extensions(names: str) -> list[str]:
    """A comma list of file extensions, dotted and lower-cased."""
    return sorted({"." + part.strip().lower().lstrip(".") for part in names.split(",") if part.strip()})
