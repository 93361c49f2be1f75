"""URLs, ports and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A link in a page or a text.
LINK = r"https?://[^\"'\s<>)\]]+"
#: Links left out by default: assets, plain pages and bare roots.
DULL = r"^.*((\.(js|css|html|org|com|ir)(\?.*)?)|/)$"


def parse_url(url: Column) -> Column:
    """struct<scheme, host, port, path, query map, fragment>; parts that are missing are null or empty."""
    rest = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    bare = F.regexp_replace(rest, "^.*@", "")
    tail = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", "")
    query = F.regexp_extract(tail, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: F.regexp_like(p, F.lit("^[^=]+=.")))
    clean = lambda t: F.coalesce(F.try_url_decode(t), t)
    entries = F.transform(pairs, lambda p: F.struct(clean(F.substring_index(p, "=", 1)).alias("key"), clean(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("value")))
    grouped = F.transform(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"]).alias("value")))
    return F.struct(
        F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"), F.lower(F.regexp_replace(bare, r":\d*$", "")).alias("host"), F.regexp_extract(bare, r":(\d+)$", 1).try_cast("int").alias("port"),
        F.regexp_extract(tail, r"^[^?#]*", 0).alias("path"), F.map_from_entries(grouped).alias("query"), F.regexp_extract(tail, r"#(.*)$", 1).alias("fragment"),
    )


def expand_ports(ports: Column) -> Column:
    """The sorted distinct ports of lists such as ``80,443,8000-8010``; null if one is out of 1..65535 or no number."""
    items = F.filter(F.transform(F.split(ports, ","), lambda p: F.trim(p)), lambda p: p != "")
    low = lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
    high = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"-\s*(\d+)$", 1), F.lit("")).try_cast("int"), low(p))
    good = F.forall(items, lambda p: F.regexp_like(p, F.lit(r"^\d{1,5}(\s*-\s*\d{1,5})?$")) & low(p).between(1, 65535) & high(p).between(1, 65535) & (low(p) <= high(p)))
    return F.when(good & (F.size(items) > 0), F.array_sort(F.array_distinct(F.flatten(F.transform(items, lambda p: F.sequence(low(p), high(p)))))))


def expand_pages(pages: Column) -> Column:
    """The zero-based pages of lists such as ``1-3,7``."""
    return F.transform(expand_ports(pages), lambda p: p - 1)


def extract_links(docs: DataFrame, id_col: str, text_col: str, match: str | None = None, keep_all: bool = False, unique: bool = False) -> DataFrame:
    """(id, pos, link) for the links of each text, in order.

    ``match`` is tried at a link's start; assets and bare roots go unless
    ``keep_all``; ``unique`` keeps a text's first occurrence of each link.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"({LINK})"), F.lit(1))
    if match:
        found = F.filter(found, lambda x: F.regexp_like(x, F.lit(f"^(?:{match})")))
    if not keep_all:
        found = F.filter(found, lambda x: ~F.regexp_like(x, F.lit(DULL)))
    if unique:
        found = F.array_distinct(found)
    return docs.select(id_col, F.posexplode(found).alias("pos", "link"))
