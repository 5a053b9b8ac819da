"""The queries of this subpackage: ``opN_<name>(spark, sf_dir)`` over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe as _bpe
from . import decontamination as _decontamination
from . import html_extraction as _html
from . import jaccard_join as _jaccard
from . import language_id as _language
from . import license_scans as _licenses
from . import quality_rules as _quality
from . import sharding as _sharding
from . import substring_dedup as _substring
from . import url_filters as _urls


def tokenizer_path() -> str:
    """The rank file of the 50,256-token byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard.jaccard_components(_read(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.html_extraction(_read(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _quality.quality_rules(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _substring.substring_dedup(_read(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bpe.byte_bpe(_read(spark, sf_dir, "documents"), tokenizer_path())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language.language_id(_read(spark, sf_dir, "documents"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _licenses.license_scan(_read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sharding.shard_documents(_read(spark, sf_dir, "documents"), shards=8)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls.url_filters(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_language_id": op4_language_id,
    "op5_license_scans": op5_license_scans,
    "op6_sharding": op6_sharding,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_html_extraction": op8_html_extraction,
    "op9_quality_rules": op9_quality_rules,
    "op10_url_filters": op10_url_filters,
}

_STOPS = ", ".join(f"'{f}'" for s in _quality.STOP_WORDS for f in (s, s.capitalize()))

ORACLE_SQL = {
    "op9_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lw
  FROM d
), p AS (
  SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w
), g AS (
  SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS g
  FROM p WINDOW o AS (PARTITION BY r ORDER BY i)
), s AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1
), c AS (
  SELECT r, sum(least(3, coalesce(nxt - i, 3))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM s) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         (length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lw) - len(list_distinct(lw)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(lw) AS n_lines, len(regexp_extract_all(t, '!')) AS n_excl,
         len(list_filter(list_distinct(w), lambda x: list_contains([{_STOPS}], x))) AS n_stop
  FROM w LEFT JOIN c USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND n_words BETWEEN 50 AND 10000000
         AND word_chars BETWEEN 2 * n_words AND 20 * n_words
         AND 100 * n_symbols <= 10 * n_words AND 100 * n_excl <= 20 * n_words
         AND n_stop >= 1 AND 100 * n_dup_lines <= 40 * n_lines
         AND 100 * n_repeat_words <= 50 * n_words AS kept
FROM m
""",
    "op2_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d
), g AS (
  SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g
  FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM w WHERE len(w) >= 13 AND doc_id IS NOT NULL)
), f AS (
  SELECT g, min(doc_id) AS first FROM g GROUP BY g
), gone AS (
  SELECT DISTINCT r, unnest(generate_series(i, i + 12)) AS i FROM g JOIN f USING (g) WHERE first < doc_id
), gr AS (
  SELECT r, list(i) AS gi FROM gone GROUP BY r
), p AS (
  SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w
), k AS (
  SELECT p.r, string_agg(x, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN gone ON gone.r = p.r AND gone.i = p.i WHERE gone.r IS NULL GROUP BY p.r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gi), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN gr USING (r) LEFT JOIN k USING (r)
""",
    "op7_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)
), e AS (
  SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l
), c AS (
  SELECT doc_id AS u, doc_id AS c FROM w
  UNION
  SELECT e.v, c.c FROM c JOIN e ON e.u = c.u WHERE c.c < e.v
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT u, min(c) AS c FROM c GROUP BY u) m ON m.u = w.doc_id
""",
    "op8_html_extraction": r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS h FROM pages
), b AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(h, '\s+', ' ', 'g'), '(?i)</?(?:p|br|h[1-6]|div|section|ul|ol|li)\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g') AS h FROM a
), c AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;?', '&', 'g') AS h FROM b
), d AS (
  SELECT page_id, url, coalesce(array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(regexp_replace(x, '[\s\xA0]+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '') AS text FROM c
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
""",
    "op10_url_filters": r"""
WITH RECURSIVE a AS (
  SELECT page_id, row_number() OVER () AS r, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, r, regexp_extract(rest, '^([^/?#]*)', 1) AS h, rest FROM a
), c AS (
  SELECT page_id, r, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^([^?#]*)', 1) AS path FROM b
), rules(verdict, rh, rp) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT c.r, arg_max(rh || rp, length(rh) * 10000 + length(rp)) AS rule, arg_max(verdict, length(rh) * 10000 + length(rp)) AS rv
  FROM c JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY c.r
), g AS (
  SELECT c.*, rule, rv, list_filter(string_split(path, '/'), lambda s: s <> '') AS sg FROM c LEFT JOIN m USING (r)
), t(r, host, sg, rv, tpl, i) AS (
  -- the tree grows by one segment of every page a step
  SELECT r, host, sg, rv, []::VARCHAR[], 0 FROM g
  UNION ALL
  SELECT r, host, sg, rv, list_append(tpl, CASE WHEN s = '*' THEN s WHEN many > 20 AND rows_ < 20 AND labels < 3 THEN '*' ELSE s END), i + 1
  FROM (
    SELECT *, count(DISTINCT CASE WHEN s <> '*' THEN s END) OVER (PARTITION BY host, tpl) AS many,
           count(*) OVER (PARTITION BY host, tpl, s) AS rows_, count(rv) OVER (PARTITION BY host, tpl, s) AS labels
    FROM (SELECT *, CASE WHEN regexp_matches(sg[i + 1], '[0-9]') THEN '*' ELSE sg[i + 1] END AS s FROM t WHERE i < len(sg))
  )
), p AS (
  SELECT host, tpl, count(*) FILTER (rv = 'block') AS nb, count(rv) AS n FROM t WHERE i = len(sg) GROUP BY host, tpl
), q AS (
  SELECT *, coalesce(list_position(list_transform(tpl, lambda s: s <> '*'), true), 0) AS f FROM p
), f AS (
  SELECT *, CASE WHEN f > 0 THEN list_concat(list_concat(tpl[:f - 1], ['*']), tpl[f + 1:]) ELSE tpl END AS fam FROM q
), x AS (
  SELECT *, sum(nb) FILTER (n >= 3) OVER w / sum(n) FILTER (n >= 3) OVER w AS pr FROM f WINDOW w AS (PARTITION BY host, fam)
), y AS (
  SELECT *, coalesce(n >= 3 AND (nb - n * pr) * (nb - n * pr) <= 1.96 * 1.96 * n * pr * (1 - pr) + 1e-9, false) AS near FROM x
), z AS (
  SELECT *, CASE WHEN near THEN sum(nb) FILTER (near) OVER w ELSE nb END AS mb, CASE WHEN near THEN sum(n) FILTER (near) OVER w ELSE n END AS mn,
         (sum(nb) OVER (PARTITION BY tpl) + 1) / (sum(n) OVER (PARTITION BY tpl) + 2) AS prior
  FROM y WINDOW w AS (PARTITION BY host, fam)
)
SELECT page_id, g.host, path, rule, coalesce(g.rv, CASE WHEN mb + 2 * prior >= 0.8 * (mn + 2) - 1e-9 THEN 'block' ELSE 'allow' END) AS verdict
FROM g JOIN t ON t.r = g.r AND t.i = len(t.sg) JOIN z ON z.host = t.host AND z.tpl = t.tpl
""",
}
