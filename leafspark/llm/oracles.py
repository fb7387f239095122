"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NON_SPACE = r"[^\x20\x09-\x0D]+"


def words(column: str, pattern: str) -> str:
    return f"regexp_extract_all({_LOWER.format(column)}, '{pattern}')"


ORACLES: dict[str, str] = {
    "op4_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {words('text', _NON_SPACE)} AS ws FROM documents),
 sh AS (SELECT doc_id, array_to_string(ws[i:i+2], ' ') AS g FROM w, unnest(range(1, len(ws)-1)) AS t(i) WHERE len(ws) >= 3
   UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) IN (1, 2)),
 n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(1) ORDER BY g)) AS s FROM sh GROUP BY doc_id),
 com AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 links AS (SELECT com.a, com.b FROM com JOIN n x ON x.doc_id = com.a JOIN n y ON y.doc_id = com.b WHERE 100*k >= 90*(x.n + y.n - k)),
 reach AS (SELECT doc_id, doc_id AS dst FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.dst),
 c AS (SELECT doc_id, min(dst) AS component_id FROM reach GROUP BY doc_id),
 deg AS (SELECT a AS doc_id, count(*) AS k FROM links GROUP BY a),
 size AS (SELECT c.component_id, count(DISTINCT n.s) AS k FROM c JOIN n USING (doc_id) GROUP BY c.component_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(size.k, 1) AS n_linked_texts, coalesce(deg.k, 0) AS n_links FROM c LEFT JOIN n USING (doc_id) LEFT JOIN deg USING (doc_id) LEFT JOIN size USING (component_id)""",
    "op7_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {words('text', _ALNUM)} AS ws FROM documents), b AS (SELECT item_id, {words('text', _ALNUM)} AS ws FROM benchmark),
 win AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i+m-1], ' ') AS g FROM (SELECT item_id, ws, least(10, len(ws)) AS m FROM b WHERE len(ws) > 0), unnest(range(1, len(ws)-m+2)) AS t(i)),
 sizes AS (SELECT DISTINCT m FROM win),
 dw AS (SELECT doc_id, m, i, array_to_string(ws[i:i+m-1], ' ') AS g FROM d, sizes, unnest(range(1, len(ws)-m+2)) AS t(i) WHERE len(ws) >= m),
 occ AS (SELECT dw.doc_id, dw.i, dw.m, win.item_id FROM dw JOIN win ON win.m = dw.m AND win.g = dw.g),
 hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+m)) AS p FROM occ) GROUP BY doc_id),
 it AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op10_warc_records": """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
}
