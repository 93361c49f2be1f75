"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, embedding_dedup, line_dedup, mixing, packing, pii, quality_classifier, quality_rules, simhash_dedup, substring_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex64(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
), l AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM l WHERE len(ws) >= 50)
), bad AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS m FROM win) WHERE m < doc_id
), gone AS (
  SELECT DISTINCT doc_id, p + k AS pos FROM bad, range(50) r(k)
), kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, pos) GROUP BY 1
)
SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM l LEFT JOIN kept USING (doc_id)
"""


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(_table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), r(vec_id, reach) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reach = l.a
), c AS (
  SELECT vec_id, min(reach) AS component_id FROM r GROUP BY 1
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1
)
SELECT c.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", *(f"n_{kind}" for kind in pii.KINDS), F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(pii.in_order(F.concat("base", "added"))).alias("spans")
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.written(quality_classifier.feature_table(_table(spark, sf_dir, "documents")))
    return quality_classifier.score_quality(rows, quality_classifier.train(rows, _table(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM d WHERE len(ws) >= 3)
), twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, range(3) r(k) GROUP BY 1
), ln AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d
), lines AS (
  SELECT doc_id, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM ln
), own AS (
  SELECT doc_id, line, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(t, '[^\x20\x09-\x0D]*[#*$%&|<>][^\x20\x09-\x0D]*')) AS marked,
    len(regexp_extract_all(t, '[A-Z]')) AS up, len(regexp_extract_all(t, '[a-z]')) AS low FROM lines WHERE t <> ''
), bad AS (
  SELECT doc_id, line, n, (n >= 8 AND NOT contains('.!?"'')]:;', right(t, 1))) OR 100 * marked > 30 * n OR (up >= 10 AND up > 3 * low)
    OR regexp_matches(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(quality_rules.BOILERPLATE)}') AS fails FROM own
), per AS (
  SELECT doc_id, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost, count(*) - count(DISTINCT line) AS dup FROM bad GROUP BY 1
), base AS (
  SELECT d.doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN per USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 40 * n_words AS kept FROM base
"""


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.simhash_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", _hex64(F.col("fp")).alias("fingerprint"), "component_id")


#: The domains of the mix: which sources each is made of.
DOMAINS = {"web": range(0, 5), "news": range(5, 10), "reference": range(10, 15), "forum": range(15, 20)}
MIX_WEIGHTS = {"domain": {"web": 4, "reference": 3, "news": 2}, "lang": {"en": 6, "de": 2}, "source": {"src0": 2}}


def domain_of(source: Column) -> Column:
    """The domain of a source; "other" for one that none lists."""
    found = F.lit("other")
    for name, numbers in DOMAINS.items():
        found = F.when(source.isin([f"src{k}" for k in numbers]), name).otherwise(found)
    return found


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), domain_of(F.col("source")), MIX_WEIGHTS, percent=100, most_epochs=4)


def _mix_sql(percent: int, epochs: int) -> str:
    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items())
        return f"CASE {level} {cases} ELSE 1 END"

    def deal(name: str, source: str, keys: str, node: str, budget: str) -> str:
        by = f"PARTITION BY {keys}" if keys else ""
        order = f"{by} ORDER BY CAST(capacity AS DOUBLE) / weight, {node}"
        return f"""
{name}1 AS (SELECT *, CAST({weight(node)} AS BIGINT) AS weight FROM {source}),
{name}2 AS (SELECT *, coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before,
  sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_after FROM {name}1),
{name}3 AS (SELECT *, capacity * w_after <= weight * ({budget} - c_before) AS full_ FROM {name}2),
{name}4 AS (SELECT *, {budget} - coalesce(sum(CASE WHEN full_ THEN capacity END) OVER ({by}), 0) AS rest, sum(CASE WHEN NOT full_ THEN weight END) OVER ({by}) AS open_weight FROM {name}3),
{name} AS (SELECT *, CASE WHEN full_ THEN capacity ELSE weight * rest // open_weight END AS dealt FROM {name}4)"""

    domain = " ".join(f"WHEN source IN ({', '.join(repr(f'src{k}') for k in numbers)}) THEN '{name}'" for name, numbers in DOMAINS.items())
    return f"""
WITH rows_ AS (
  SELECT doc_id, coalesce(CASE {domain} ELSE 'other' END, '(none)') AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents
), leaves AS (
  SELECT domain, lang, source, count(*) AS n_docs, sum(n_tokens) AS tokens, {epochs} * sum(n_tokens) AS capacity FROM rows_ GROUP BY ALL
), langs AS (SELECT domain, lang, sum(capacity) AS capacity FROM leaves GROUP BY ALL),
domains AS (SELECT domain, sum(capacity) AS capacity, (SELECT sum(n_tokens) * {percent} // 100 FROM rows_) AS total FROM langs GROUP BY 1),
{deal("top", "domains", "", "domain", "total")},
mid0 AS (SELECT langs.*, top.dealt AS d_budget FROM langs JOIN top USING (domain)),
{deal("mid", "mid0", "domain", "lang", "d_budget")},
low0 AS (SELECT leaves.*, mid.dealt AS l_budget FROM leaves JOIN mid USING (domain, lang)),
{deal("low", "low0", "domain, lang", "source", "l_budget")},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN dealt // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN dealt % tokens ELSE -1 END AS left_ FROM low),
run AS (
  SELECT rows_.*, epochs, left_, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('1:' || CAST(epochs AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS run
  FROM rows_ JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN run <= left_ THEN 1 ELSE 0 END AS BIGINT) AS copies FROM run
"""


OP7_SQL = _mix_sql(100, 4)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), lines AS (
  SELECT doc_id, ln, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS pos, t
  FROM (SELECT doc_id, ln, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM raw) WHERE t <> ''
), win AS (
  SELECT doc_id, pos, t || chr(10) || lead(t, 1) OVER (PARTITION BY doc_id ORDER BY pos) || chr(10) || lead(t, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS w
  FROM lines
), bad AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM win WHERE w IS NOT NULL) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM bad, range(3) r(k)
), out_at AS (
  SELECT lines.doc_id, lines.ln FROM lines JOIN gone USING (doc_id, pos)
), kept AS (
  SELECT raw.doc_id, string_agg(line, chr(10) ORDER BY ln) AS t FROM raw ANTI JOIN out_at USING (doc_id, ln) GROUP BY 1
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(g, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS g FROM out_at GROUP BY 1) USING (doc_id)
"""


def tokenizer_files() -> tuple[str, str, str]:
    """The byte-level BPE tokenizer, its ranks and their pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(_table(spark, sf_dir, "documents"), *tokenizer_files())


#: The contract's rules.
SITE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words that as a whole token of a URL get it blocked where no site rule fits.
BLOCKED_WORDS = ("casino", "poker", "viagra", "porn", "xxx", "torrent", "warez", "escort")
#: Phrases of several tokens, treated alike.
BLOCKED_PHRASES = ("cheap-pills", "free-download", "online-pharmacy", "payday-loans")


def url_rules() -> list[url_filter.Rule]:
    words = [url_filter.Rule(w, "block", rf"(?i)(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)", "url", tuple(url_filter.tokens_of(w)), 1) for w in (*BLOCKED_WORDS, *BLOCKED_PHRASES)]
    return [*(url_filter.site_rule(site, verdict) for site, verdict in SITE_RULES), *words]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(_table(spark, sf_dir, "pages"), url_rules())
    site = F.col("rule").isin([s for s, _ in SITE_RULES])
    return out.select("page_id", "host", "path", F.when(site, F.col("rule")).alias("rule"), "verdict")


OP10_SQL = rf"""
WITH u AS (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block'
  ELSE CASE WHEN regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9])({"|".join((*BLOCKED_WORDS, *BLOCKED_PHRASES))})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END END AS verdict
FROM r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_pii": op3_pii,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_url_filter": op10_url_filter,
}
ORACLE: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op2_embedding_dedup": OP2_SQL,
    "op5_quality_rules": OP5_SQL,
    "op7_source_mixing": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_url_filter": OP10_SQL,
}
