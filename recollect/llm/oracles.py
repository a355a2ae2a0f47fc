"""SQL that gives the rows of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

from .warc_revisits import SCHEME, TRACKING


def _canonical(u: str) -> str:
    host = rf"regexp_replace(regexp_replace(lower(regexp_extract({u}, '{SCHEME}(?:[^/?#@]*@)?([^/?#]*)', 1)), ':(80|443)?$', ''), '^www\d*\.', '')"
    path = rf"regexp_replace(regexp_extract({u}, '{SCHEME}[^/?#]*([^?#]*)', 1), '/+$', '')"
    query = rf"array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{TRACKING}'))), '&')"
    return f"CASE WHEN {host} = '' THEN {u} ELSE {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END"


OP8 = f"""
WITH page AS (SELECT page_id, trim(url) AS url, coalesce(html, '') AS html, md5(coalesce(html, '')) AS tag FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL),
response AS (SELECT page_id * 3 AS id, {_canonical('url')} AS c, page_id AS t, tag, page_id % 1000 AS day, length(html) AS n FROM page),
asked AS (
  SELECT page_id * 3 + 1 AS id, CASE WHEN regexp_matches(url, '[?#]') THEN url ELSE regexp_replace(url, '^https', 'http') || '?utm_source=again' END AS u, page_id + 1000000000 AS t, tag, NULL::BIGINT AS day, 'max-age=' || (page_id % 100) AS cache, 'hit' AS x FROM page
  UNION ALL
  SELECT page_id * 3 + 2, url, CASE WHEN page_id % 3 = 2 THEN -1 - page_id ELSE page_id + 2000000000 END, CASE page_id % 3 WHEN 0 THEN 'another' WHEN 2 THEN tag END, CASE WHEN page_id % 3 = 1 THEN page_id % 1000 END, NULL, NULL FROM page),
revisit AS (SELECT *, {_canonical('u')} AS c FROM asked),
latest AS (SELECT v.id, max(struct_pack(t := r.t, id := r.id)) AS m FROM revisit v JOIN response r ON r.c = v.c AND (r.t < v.t OR r.t = v.t AND r.id < v.id) GROUP BY v.id),
found AS (SELECT v.*, r.id AS rid, r.n, CASE WHEN r.id IS NULL THEN 'no earlier response' WHEN coalesce(v.tag = r.tag, v.day = r.day) IS NULL THEN 'unvalidated' WHEN coalesce(v.tag = r.tag, v.day = r.day) THEN 'resolved' ELSE 'changed' END AS outcome
  FROM revisit v LEFT JOIN latest l ON l.id = v.id LEFT JOIN response r ON r.id = l.m.id)
SELECT id AS record_id, c AS canonical_url, outcome, rid AS response_id,
  CASE WHEN outcome = 'resolved' THEN coalesce(cache, 'max-age=60') END AS cache_control,
  CASE WHEN outcome = 'resolved' THEN n::VARCHAR END AS content_length,
  CASE WHEN outcome = 'resolved' THEN 5 + CASE WHEN x IS NULL THEN 0 ELSE 1 END END AS n_headers,
  CASE WHEN outcome = 'resolved' THEN (SELECT md5(coalesce(html, '')) FROM pages p WHERE p.page_id * 3 = rid) END AS payload_md5
FROM found
"""

ORACLE_SQL: dict[str, str] = {"op8_warc_revisits": OP8}
