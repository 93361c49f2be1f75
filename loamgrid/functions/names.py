"""Identifiers from keys; metadata work on the driver."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

FALLBACK = "column"
MOST_BYTES = 63
#: Space, dashes, dots, slashes and the zero-width non-joiner stand between words.
_BETWEEN = re.compile("[\\s\\-./\\\\‌]+")
_HUMP = re.compile("(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def cut_bytes(name: str, most: int = MOST_BYTES) -> str:
    """The longest start of ``name`` within ``most`` bytes of UTF-8."""
    return name.encode()[:most].decode(errors="ignore")


def _plain(char: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
    return bare if bare and bare.isascii() else char


def sanitize(key: str) -> str:
    """A key as a lower-case identifier with underscores."""
    text = "".join(map(_plain, unicodedata.normalize("NFKC", key))).strip()
    text = _HUMP.sub("_", _BETWEEN.sub("_", text))
    text = "".join(c if c.isalnum() or unicodedata.category(c) in ("Mn", "Mc") else "_" for c in text).lower()
    text = re.sub("_+", "_", text).strip("_")
    if not text:
        return FALLBACK
    return cut_bytes("_" + text if text[0].isdigit() else text)


def identifier(key: str, raw: bool = False) -> str:
    if raw:
        return cut_bytes(key) if key.strip() else FALLBACK
    return sanitize(key)


def unique_names(keys: Iterable[str], raw: bool = False) -> list[str]:
    """Identifiers without collisions: later ones get ``_2``, ``_3``, past names already taken."""
    taken: dict[str, int] = {}
    out = []
    for key in keys:
        base = name = identifier(key, raw)
        n = taken.get(base, 0)
        while name in taken:
            n += 1
            name = f"{base}_{max(2, n)}"
        taken[base] = max(taken.get(base, 0), n, 1)
        taken.setdefault(name, 1)
        out.append(name)
    return out


def header_names(cells: Iterable[str | None]) -> list[str]:
    """Header cells as names: blanks are numbered by place, repeats get ``_2``, ``_3``."""
    seen: dict[str, int] = {}
    out = []
    for place, cell in enumerate(cells, 1):
        name = (cell or "").strip() or f"column_{place}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def index_name(table: str, columns: Iterable[str]) -> str:
    return cut_bytes(f"idx_{sanitize(table)}_{sanitize('_'.join(columns))}")
