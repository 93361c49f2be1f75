"""URL filtering by pattern rules that are indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are broadcast up to so many; more are joined by a shuffle on the token.
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """A verdict for the URLs that a regular expression finds.

    ``scope`` is what it is applied to: "site" (host, then path) or "url".
    ``literals`` are lower-case tokens that every URL it fits must contain; of
    several rules that fit, the largest ``rank`` wins and then the least ``name``.
    """

    name: str
    verdict: str
    pattern: str
    scope: str
    literals: tuple[str, ...]
    rank: int


def tokens_of(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def site_rule(site: str, verdict: str, base: int = 1 << 20) -> Rule:
    """A rule for a host with its subdomains and the paths that start with the rule's; the longer wins."""
    host, _, path = site.partition("/")
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}"
    whole = [*tokens_of(host)]
    parts = re.split("[^a-z0-9]+", path.lower())
    if path.isascii() and path == path.lower():  # the last part may go on in the URL unless the path ends it
        whole += [t for t in parts[:-1] if t]
    return Rule(site, verdict, pattern, "site", tuple(dict.fromkeys(whole)), base + len(site))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_index(rules: list[Rule], counts: Mapping[str, int]) -> list[tuple]:
    """(token, rule) by each rule's literal token that the fewest URLs hold; '' for rules without one."""
    rarity = lambda t: (counts.get(t, 0), -len(t), t)
    return [(min(r.literals, key=rarity) if r.literals else "", r.name, r.verdict, r.pattern, r.scope, r.rank) for r in rules]


def _tokens(url: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(url), "[^a-z0-9]+")), lambda t: t != "")


def literal_counts(urls: DataFrame, url: Column, rules: list[Rule]) -> dict[str, int]:
    """In how many of all URLs each literal token of the rules occurs: a number for each literal."""
    known = sorted({t for r in rules for t in r.literals})
    literals = urls.sparkSession.createDataFrame([(t,) for t in known], "token string")
    if len(known) <= BROADCAST_RULES:
        literals = F.broadcast(literals)
    found = urls.select(F.explode(_tokens(url)).alias("token")).join(literals, "token", "left_semi").groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()}


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every URL: (page_id, host, path, rule, verdict), one row per input row.

    The rules' literal tokens are counted over all URLs and every rule is indexed
    under its rarest.  A URL's distinct lower-cased alphanumeric tokens fetch the
    rules indexed under them, and only those run their regular expressions.  ``rule`` names the
    best rule that fits (null without one); ``verdict`` is that rule's, else
    ``default``.  A null URL or one without ``://`` has an empty host and path;
    only rules on the whole URL can fit it, and none fits a null.  Distinct URLs
    are judged once, then joined back; repeated rows each get their row.  Null ids
    are kept.  Other columns of ``pages`` are not read.
    """
    spark = pages.sparkSession
    counts = literal_counts(pages, F.col(url_col).cast("string"), rules)
    index = spark.createDataFrame(rule_index(rules, counts), "token string, name string, verdict string, pattern string, scope string, rank int")
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("__u"))
    host, path = url_parts(F.col("__u"))
    urls = rows.select("__u").filter("__u is not null").distinct().select("__u", host.alias("host"), path.alias("path"))
    tokens = F.array_append(_tokens(F.col("__u")), F.lit(""))
    found = urls.select("__u", F.concat("host", "path").alias("site"), F.explode(tokens).alias("token")).join(index, "token")
    found = found.filter(F.expr("regexp_like(CASE WHEN scope = 'site' THEN site ELSE __u END, pattern)"))
    best = found.groupBy("__u").agg(F.min_by(F.struct("name", "verdict"), F.struct((-F.col("rank")).alias("rank"), "name")).alias("best"))
    best = best.select(F.concat("__u", F.lit("")).alias("__best"), "best")  # shuffled anew: a frequent URL's rows may be split
    return (
        rows.join(best, F.col("__u") == F.col("__best"), "left")
        .select("page_id", host.alias("host"), path.alias("path"), F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )
