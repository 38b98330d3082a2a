"""DuckDB SQL for the operators that SQL expresses in full."""

SQL = {
    "op3_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS digest FROM pages
        ), f AS (SELECT digest, min(page_id) AS first FROM p WHERE size >= 100 GROUP BY digest)
        SELECT p.page_id, CAST(p.size AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN f.first IS NOT NULL AND f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
        FROM p LEFT JOIN f USING (digest)
    """,
    "op8_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
            FROM documents
        ), k AS (
            SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
        ), d AS (
            SELECT key, max(doc_id) AS newest FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), m AS (
            SELECT k.doc_id, k.i, k.line, d.key IS NOT NULL AND k.doc_id <> d.newest AS gone FROM k LEFT JOIN d ON k.key = d.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
}
