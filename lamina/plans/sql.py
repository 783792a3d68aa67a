"""Pieces of SQL that the queries' SQL shares."""

from __future__ import annotations

from lamina.functions.text import SPACE

WORDS = "regexp_extract_all(replace(lower(nfc_normalize({})), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')"
SQUEEZED = "trim(regexp_replace(nfc_normalize(coalesce({}, '')), '[" + SPACE.replace("{", "{{").replace("}", "}}") + "]+', ' ', 'g'), ' ')"
FILLED = "regexp_replace(text, '[" + SPACE + "]+', '', 'g') <> ''"
BLANK = "[" + SPACE + "]"
STRIP = f"regexp_replace({{}}, '^{BLANK.replace('{', '{{').replace('}', '}}')}+|{BLANK.replace('{', '{{').replace('}', '}}')}+$', '', 'g')"
NORM = r"regexp_replace(nfc_normalize({}), '\r\n?', chr(10), 'g')"
CHILD = rf"""one AS (SELECT DISTINCT ON (chunk_id) chunk_id, source, text, page_start, page_end, structure FROM chunks WHERE strategy = 'hierarchical' AND chunk_id IS NOT NULL),
r0 AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(chunk_id, ':([0-9]+)$', 1), '') AS BIGINT), 0) AS number, nullif(structure.chapter, '') AS mc, nullif(structure.article, '') AS ma,
  nullif(regexp_extract({STRIP.format("coalesce(text, '')")}, '(?i)^(Chương{BLANK}+[IVXLCDM]+|Điều{BLANK}+\p{{Nd}}+)', 1), '') AS h FROM one),
r1 AS (SELECT *, CASE WHEN lower(h) LIKE 'điều%' THEN h END AS ha, CASE WHEN lower(h) NOT LIKE 'điều%' THEN h END AS hc, mc IS NOT NULL OR ma IS NOT NULL AS hm FROM r0),
r2 AS (SELECT *, CASE WHEN hm THEN mc ELSE hc END AS oc, CASE WHEN hm THEN ma ELSE ha END AS oa FROM r1),
r3 AS (SELECT *, last_value(oc IGNORE NULLS) OVER w AS cc, last_value(oa IGNORE NULLS) OVER w AS ca FROM r2 WINDOW w AS (PARTITION BY source ORDER BY number, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ch AS (SELECT chunk_id, source, number, CASE WHEN hm THEN mc ELSE coalesce(hc, cc) END AS chapter, CASE WHEN hm OR h IS NOT NULL THEN oa ELSE ca END AS article, nullif(structure.clause, '') AS clause, nullif(structure.point, '') AS point,
  CASE WHEN hm THEN 'metadata' WHEN h IS NOT NULL THEN 'heading_inferred' WHEN cc IS NOT NULL OR ca IS NOT NULL THEN 'carried_forward' ELSE 'document_fallback' END AS method,
  concat_ws('; ', CASE WHEN hm AND hc IS NOT NULL AND hc IS DISTINCT FROM mc THEN 'Metadata chapter ' || chr(39) || coalesce(mc, 'None') || chr(39) || ' conflicts with inferred heading ' || chr(39) || hc || chr(39) END,
    CASE WHEN hm AND ha IS NOT NULL AND ha IS DISTINCT FROM ma THEN 'Metadata article ' || chr(39) || coalesce(ma, 'None') || chr(39) || ' conflicts with inferred heading ' || chr(39) || ha || chr(39) END) AS warnings,
  hm AND ((hc IS NOT NULL AND hc IS DISTINCT FROM mc) OR (ha IS NOT NULL AND ha IS DISTINCT FROM ma)) AS ambiguous, text, page_start, page_end FROM r3)"""


def windows_sql(most: int) -> str:
    """ch (children), pw (parents with text) and pm (chunk_id, parent_id), for a recursive WITH."""
    return f"""{CHILD},
k AS (SELECT *, coalesce(article, 'document_fallback') AS article_key, length(text) AS n, row_number() OVER (PARTITION BY source, coalesce(article, 'document_fallback') ORDER BY number, chunk_id) AS i FROM ch WHERE text IS NOT NULL),
f AS (SELECT source, article_key, i, chunk_id, 1 AS w, n::BIGINT AS used FROM k WHERE i = 1
  UNION ALL SELECT k.source, k.article_key, k.i, k.chunk_id, CASE WHEN f.used + 1 + k.n > {most} THEN f.w + 1 ELSE f.w END, CASE WHEN f.used + 1 + k.n > {most} THEN k.n ELSE f.used + 1 + k.n END
  FROM f JOIN k ON k.source IS NOT DISTINCT FROM f.source AND k.article_key = f.article_key AND k.i = f.i + 1),
pk AS (SELECT k.*, f.w AS window_index, substr(sha256(concat_ws('_', k.source, k.article_key, f.w::VARCHAR)), 1, 12) AS parent_id FROM f JOIN k ON k.chunk_id = f.chunk_id),
pm AS (SELECT chunk_id, parent_id FROM pk),
pw AS (SELECT parent_id, source, article_key, window_index, min(page_start) AS page_start, max(page_end) AS page_end, count(*) AS n_children, count(*) FILTER (ambiguous) AS ambiguous_count, string_agg(chunk_id, ',' ORDER BY number, chunk_id) AS child_ids,
  string_agg(text, chr(10) ORDER BY number, chunk_id) AS text, length(string_agg(text, chr(10) ORDER BY number, chunk_id)) AS char_count, length(string_agg(text, chr(10) ORDER BY number, chunk_id)) > {most} AND count(*) = 1 AS oversize FROM pk GROUP BY 1, 2, 3, 4)"""
