"""SQL for DuckDB of those corpus queries that SQL can express. It is for the small tables: windows of words and
positions of matches are plain rows there."""

from __future__ import annotations

from metriclake.llm import secrets

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d)),
earliest AS (SELECT h, MIN(doc_id) AS least FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN earliest USING (h), (SELECT unnest(range(0, 50)) AS k) WHERE doc_id > least),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, COUNT(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)"""

BYTES = r"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS x FROM documents),
chunks AS (SELECT doc_id, c, substr(x, 400 * c + 1, 800) AS y FROM (SELECT doc_id, x, unnest(range(0, length(x) // 400 + 1)) AS c FROM d)),
windows AS (SELECT doc_id, 200 * c + j AS i, md5(substr(y, 2 * j + 1, 400)) AS h FROM (SELECT doc_id, c, y, unnest(range(0, least(200, greatest(length(y) // 2 - 199, 0)))) AS j FROM chunks)),
again AS (SELECT doc_id, i FROM windows SEMI JOIN (SELECT h FROM windows GROUP BY h HAVING COUNT(*) > 1) USING (h)),
runs AS (SELECT doc_id, MIN(i) AS a, MAX(i) + 200 AS b FROM (SELECT *, SUM(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM
 (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM again)) GROUP BY doc_id, g),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM runs UNION ALL SELECT doc_id, MAX(b), 1000000000 FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS y FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, SUM(b - a) AS n, COUNT(*) AS k FROM runs GROUP BY doc_id) USING (doc_id)"""

PAGES = r"""
WITH parts AS (SELECT page_id, url, unnest(string_split_regex(a, '</?(?:p|h1)>')) AS part, unnest(range(len(string_split_regex(a, '</?(?:p|h1)>')))) AS k
 FROM (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages)),
plain AS (SELECT page_id, url, k, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(replace(part, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS block FROM parts)
SELECT page_id, url, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY k) FILTER (block <> ''), '') AS text, length(coalesce(string_agg(block, chr(10) || chr(10) ORDER BY k) FILTER (block <> ''), '')) AS n_chars
FROM plain GROUP BY page_id, url"""

NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
 FROM p JOIN s USING (anchor_id) WHERE label <> anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

MIDDLES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, text, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[25:32] AS BIGINT) AS h4, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS n FROM d),
c AS (SELECT *, string_split(text, chr(10)) AS lines, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
k AS (SELECT *, CAST(least(length(text), coalesce(list_sum(list_transform(lines[1:a], lambda l: length(l) + 1)), 0)) AS BIGINT) AS p, CAST(least(length(text), coalesce(list_sum(list_transform(lines[1:b], lambda l: length(l) + 1)), 0)) AS BIGINT) AS q FROM c),
o AS (SELECT doc_id, n, text, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, p, q, substr(text, 1, p) AS prefix, substr(text, p + 1, q - p) AS middle, substr(text, q + 1) AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM o"""


def secret_scan() -> str:
    """Matches of each rule by the running lengths of matches and of what stands between them."""
    parts = []
    for rank, rule in enumerate(secrets.BASE + secrets.ADDED):
        pattern = rule.pattern.replace("'", "''")
        group, least = rule.kept
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, b AS start, b + length(m[k]) AS stop FROM (SELECT doc_id, m, g, k, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS b"
            f" FROM (SELECT doc_id, m, g, gaps, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS g, string_split_regex(text, '{pattern}') AS gaps FROM documents))) WHERE length(g[k]) >= {least}"
        )
    counts = ", ".join(f"COUNT(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    shown = "kind || ':' || start || ':' || stop"
    kinds = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    return (
        f"WITH found AS ({' UNION ALL '.join(parts)}) SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({shown}, ',' ORDER BY start, rank) FILTER (kind IN ({kinds})), '')) AS base_sha256,"
        f" coalesce(string_agg({shown}, ',' ORDER BY start, rank), '') AS spans FROM documents d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id"
    )


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": SUBSTRINGS.strip(), "op4_suffix_array_dedup": BYTES.strip(), "op7_secret_scan": secret_scan(), "op10_html_extraction": PAGES.strip(), "op12_hard_negatives": NEGATIVES.strip(), "op13_fill_in_middle": MIDDLES.strip()}
