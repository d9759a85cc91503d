"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidelog.llm.quality import RULES, STOP_WORDS
from tidelog.llm.url_filter import MIN_SOFT, SOFT, STRICT, THRESHOLD

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _verdict() -> str:
    parts = []
    for r in RULES:
        if r.low is not None:
            parts.append(f"{r.top} >= {r.low} * {r.bottom}")
        if r.high is not None:
            parts.append(f"{r.top} <= {r.high} * {r.bottom}")
    return " AND ".join(parts)


QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs,
    len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{s}'" for s in STOP_WORDS)})))::BIGINT AS n_stop_words,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_verdict()} AS kept
FROM f
"""

MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
    (('0x' || md5(concat_ws(':', 'mix-1', coalesce(doc_id::VARCHAR, ''), coalesce(text, '')))[1:13])::BIGINT::DOUBLE
      + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS cap,
    [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), m AS (
  SELECT d.source, size, rest, sum(size * n) OVER w - size * n AS certain,
    sum((1 + ln(1.0 + size)) * size * n) OVER (PARTITION BY d.source ORDER BY size DESC
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others
  FROM (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL) d
  JOIN (SELECT source, target - whole * source_size AS rest FROM p) p ON d.source IS NOT DISTINCT FROM p.source
  WINDOW w AS (PARTITION BY d.source ORDER BY size DESC ROWS UNBOUNDED PRECEDING)
), c AS (SELECT source, max((rest - certain) / others) AS scale FROM m GROUP BY source), r AS (
  SELECT d.*, least(1.0::DOUBLE, coalesce(scale, 0) * (1 + ln(1.0 + size))) AS pr
  FROM d LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
), q AS (SELECT *, CASE WHEN pr > 0 THEN (u / (1 - u)) * (1 - pr) / pr END AS q FROM r),
v AS (SELECT *, coalesce(q / (1 + q), 1.0) AS v FROM q), k AS (
  SELECT v.*, source_size, target, whole, target - whole * source_size AS rest,
    sum(size) OVER (PARTITION BY v.source ORDER BY v.v RANGE UNBOUNDED PRECEDING) AS reached,
    sum(size) OVER (PARTITION BY v.source, v.v) AS words
  FROM v JOIN p ON v.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN rest > reached - words AND (reached < rest OR reached - rest <= rest - (reached - words))
    THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k
"""



def _found(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::INTEGER"


def _strict_hits() -> str:
    """Hits of each strict term; doubling the blanks between lets neighbours share a boundary character."""
    return " + ".join(
        f"len(regexp_extract_all(regexp_replace(u, '([^a-z0-9])', '\\1\\1', 'g'), '(?:^|[^a-z0-9]){t}(?:[^a-z0-9]|$)'))" for t in STRICT)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
URLS = rf"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest,
    translate(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE coalesce(url, '') END,
      '{_UPPER}', '{_UPPER.lower()}') AS u
  FROM pages
), p AS (
  SELECT page_id, u, translate(coalesce(regexp_extract(rest, '(?s)^[^/?#]*'), ''), '{_UPPER}', '{_UPPER.lower()}') AS host,
    coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path
  FROM r
), h AS (
  SELECT *, '.' || host AS dotted, ({_strict_hits()})::INTEGER AS n_strict,
    ({" + ".join(_found(t) for t in SOFT)})::INTEGER AS n_soft,
    ({" + ".join(f"{w} * {_found(t)}" for t, w in SOFT.items())})::INTEGER AS weight
  FROM p
), v AS (
  SELECT *, CASE WHEN dotted LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN dotted LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN dotted LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN dotted LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM h
)
SELECT page_id, host, path, rule, n_strict, n_soft,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN n_strict > 0 OR (n_soft >= {MIN_SOFT} AND weight >= {THRESHOLD}) THEN 'block' ELSE 'allow' END AS verdict
FROM v
"""

ORACLES = {"op3_mix_sources": MIX, "op7_quality_rules": QUALITY, "op12_url_filter": URLS}
