"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from vitrine.llm.decontaminate import LEAST, MASKS, MISMATCH, SHARE, SPAN
from vitrine.llm.license import PHRASES, SENTENCE_END, TEMPLATES, THRESHOLD, notices, words_of
from vitrine.llm.urls import SUFFIXES, SURE

#: The strength of a level's prior: prior_strength() of urls.py in SQL.
_STRENGTH = """
  SELECT CASE WHEN k < 2 OR n IS NULL OR n = 0 OR bad = 0 OR bad = n THEN 10.0
         ELSE 1 / least(greatest(CASE WHEN room > 0 THEN (spread - w * (k - 1)) / room ELSE 0.5 END, 1.0 / 1001), 1.0 / 6) - 1 END AS m
  FROM (SELECT *, bb - 2 * mean * bad + mean * mean * n AS spread, w * (n - nn / n - (k - 1)) AS room
        FROM (SELECT *, bad / n AS mean, (bad / n) * (1 - bad / n) AS w
              FROM (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(n * n)::DOUBLE AS nn, sum(bad * bad / n::DOUBLE) AS bb FROM {level} WHERE n > 0)))
"""

URL_FILTER = f"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts),
judged AS (
  SELECT *, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled FROM ruled),
hosts AS (
  SELECT *, regexp_replace(domain, '^[^.]*\\.', '') AS suffix FROM (
    SELECT host, CASE WHEN regexp_full_match(name, '[0-9.]+') THEN name WHEN list_contains({SUFFIXES}, regexp_extract(name, '[^.]*(\\.[^.]*)?$')) THEN regexp_extract(name, '[^.]*(\\.[^.]*(\\.[^.]*)?)?$') ELSE regexp_extract(name, '[^.]*(\\.[^.]*)?$') END AS domain,
           n, bad FROM (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':\\d*$', '') AS name, count(ruled) AS n, count(*) FILTER (WHERE ruled = 'block') AS bad FROM judged GROUP BY host))),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
tops AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
mh AS ({_STRENGTH.format(level="hosts")}), md AS ({_STRENGTH.format(level="domains")}), ms AS ({_STRENGTH.format(level="tops")}),
total AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM tops),
top_mean AS (SELECT suffix, n + w AS known, (bad + w * above) / (n + w) AS mean
             FROM (SELECT t.*, least((SELECT m FROM ms), total.n + 1) AS w, (total.bad + 0.5) / (total.n + 1) AS above FROM tops t, total)),
domain_mean AS (SELECT domain, n + w AS known, (bad + w * above) / (n + w) AS mean
                FROM (SELECT d.*, least((SELECT m FROM md), t.known) AS w, t.mean AS above FROM domains d JOIN top_mean t USING (suffix))),
host_mean AS (SELECT host, n + w AS known, (bad + w * above) / (n + w) AS mean
              FROM (SELECT h.*, least((SELECT m FROM mh), d.known) AS w, d.mean AS above FROM hosts h JOIN domain_mean d USING (domain))),
reputation AS (SELECT host, mean - {SURE / (1 - SURE)} ** 0.5 * sqrt(mean * (1 - mean) / (known + 1)) > 0.5 AS blocked FROM host_mean)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM judged JOIN reputation USING (host)
"""


WARC = """
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM payloads WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM payloads LEFT JOIN firsts USING (payload_digest)
"""


_MASKS = ", ".join(f"({i}, {[p for p, c in enumerate(mask) if c == '1']})" for i, mask in enumerate(MASKS))

#: Words are compared themselves, not by hash. The tables have no items under twelve words, which have seeds of their own.
DECONTAMINATE = f"""
WITH mask(seed, places) AS (VALUES {_MASKS}),
item AS (
  SELECT min(item_id) AS item_id, count(*) AS items, words FROM (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM benchmark)
  GROUP BY words HAVING len(words) >= {SPAN}),
doc AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM documents),
item_window AS (SELECT item_id, seed, i AS item_at, list_transform(places, lambda p: words[i + p + 1])::VARCHAR AS key
                FROM (SELECT *, unnest(range(len(words) - {SPAN - 1})) AS i FROM item), mask),
doc_window AS (SELECT doc_id, seed, i AS spot, list_transform(places, lambda p: words[i + p + 1])::VARCHAR AS key
               FROM (SELECT *, unnest(range(greatest(0, len(words) - {SPAN - 1}))) AS i FROM doc), mask),
lying AS (SELECT doc_id, item_id, spot - item_at AS shift, count(*) AS hits, min(spot) AS first_hit FROM doc_window JOIN item_window USING (seed, key) GROUP BY ALL),
side AS (
  SELECT doc_id, item_id, shift, unnest(range(greatest(0, -shift), least(len(d.words) - shift, len(i.words)))) AS p, d.words AS own, i.words AS its
  FROM lying JOIN doc d USING (doc_id) JOIN item i USING (item_id)),
run AS (
  SELECT doc_id, item_id, shift, p, sum(CASE WHEN own[p + shift + 1] = its[p + 1] THEN 1.0::DOUBLE ELSE -{MISMATCH}::DOUBLE END) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) AS total FROM side),
best AS (
  SELECT doc_id, item_id, shift, total - least(0, coalesce(min(total) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS score FROM run),
scored AS (SELECT doc_id, item_id, shift, max(score) AS score FROM best GROUP BY ALL)
SELECT doc_id, item_id, items, len(words)::INTEGER AS item_words, sum(hits)::BIGINT AS hits, max(score) AS score, min(first_hit)::BIGINT AS first_word
FROM scored JOIN lying USING (doc_id, item_id, shift) JOIN item USING (item_id)
WHERE score >= least({LEAST}::DOUBLE, {SHARE}::DOUBLE * len(words)) GROUP BY ALL
"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _windows(words: str, templates: list[tuple[str, str]]) -> str:
    """Distinct words of the windows of a list of words: twice the longest template's, half over the next."""
    n = max(len(words_of(t)) for _, t in templates)
    return f"SELECT doc_id, list_distinct(words[spot + 1 : spot + {2 * n}]) AS block FROM (SELECT doc_id, words, unnest(range(0, greatest(1, len(words) - {n}), {n})) AS spot FROM {words})"


def _met(block: str, templates: list[tuple[str, str]]) -> str:
    rows = ", ".join(f"('{label}', list_distinct({[w.decode() for w in words_of(t)]}))" for label, t in templates)
    return f"SELECT doc_id, label, len(list_intersect(template, block)) / len(template)::DOUBLE AS share FROM {block}, (VALUES {rows}) AS t(label, template) WHERE len(list_intersect(template, block)) >= ceil({THRESHOLD} * len(template) - 1e-9)"


_SENTENCES, _NOTICES = notices(TEMPLATES)

LICENSE = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_WORD}') AS words, {_FOLDED} AS folded FROM documents),
phrase(label, phrase) AS (VALUES {", ".join(f"('{label}', {phrase.split()})" for phrase, label in PHRASES)}),
place AS (SELECT doc_id, i AS spot, label FROM (SELECT *, unnest(range(len(words))) AS i FROM doc), phrase WHERE words[i + 1 : i + len(phrase)] = phrase),
sentence AS (SELECT doc_id, regexp_extract_all(s, '{_WORD}') AS words FROM (SELECT doc_id, unnest(regexp_split_to_array(folded, '{SENTENCE_END}')) AS s FROM doc)),
sentence_block AS ({_windows("sentence", _SENTENCES)}),
notice_block AS ({_windows("doc", _NOTICES)}),
met AS ({_met("sentence_block", _SENTENCES)} UNION ALL {_met("notice_block", _NOTICES)}),
base AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM place GROUP BY doc_id),
every AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM (SELECT doc_id, label FROM place UNION ALL SELECT doc_id, label FROM met) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM doc LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": DECONTAMINATE, "op5_license_scan": LICENSE, "op7_url_filter": URL_FILTER, "op9_warc": WARC}
