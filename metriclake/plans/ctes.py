"""The derived tables of sources.derived in DuckDB's SQL, for the queries' oracles."""

from __future__ import annotations

CTES = {
    "hits": (
        (),
        """SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
 'client-' || (user_id % 2) AS client_id, 'site-' || (user_id % 7) AS site_id,
 '/s' || (CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 5) || '/' || regexp_extract(props, '[0-9]+') AS route,
 CASE WHEN CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 10 = 0 THEN 'image' ELSE 'web' END AS search_type FROM events""",
    ),
    "cells": (
        ("hits",),
        """SELECT client_id, site_id, route, search_type, day, COUNT(*) FILTER (event_type = 'view') AS impressions,
 COUNT(*) FILTER (event_type = 'click') AS clicks, MIN(CASE WHEN event_type = 'view' THEN CAST(value AS DECIMAL(18,2)) END) AS position,
 COUNT(*) FILTER (event_type = 'purchase') AS pageviews, MAX(ts) AS observed_at FROM hits GROUP BY ALL""",
    ),
    "facts": (
        ("cells",),
        """SELECT client_id, site_id, source, metric, unit, CAST(day AS TIMESTAMP) AS start_ts, CAST(day + 1 AS TIMESTAMP) AS end_ts, 'day' AS grain,
 CAST(value AS DECIMAL(18,4)) AS value, route, search_type, CASE WHEN day >= DATE '2024-01-29' THEN 'provisional' ELSE 'final' END AS completeness,
 observed_at, CASE WHEN day(day) = 13 AND source = 'web' THEN 0 ELSE 1 END AS identity_version, day FROM (
 SELECT *, 'search' AS source, 'search.impressions' AS metric, 'count' AS unit, CAST(impressions AS DECIMAL(18,4)) AS value FROM cells
 UNION ALL SELECT *, 'search', 'search.clicks', 'count', CAST(clicks AS DECIMAL(18,4)) FROM cells
 UNION ALL SELECT *, 'search', 'search.position', 'rank', CAST(position AS DECIMAL(18,4)) FROM cells
 UNION ALL SELECT *, 'web', 'web.pageviews', 'count', CAST(pageviews AS DECIMAL(18,4)) FROM cells) WHERE value > 0""",
    ),
    "runs": (
        ("hits",),
        """SELECT site_id || '|' || source || '|' || strftime(day, '%Y-%m-%d') AS run_id, site_id || '|' || source AS binding_key, site_id, source,
 CAST(day AS TIMESTAMP) AS window_start, CAST(day + 1 AS TIMESTAMP) AS window_end, CAST(day AS TIMESTAMP) AS started_at, last_ts AS finished_at,
 CASE WHEN errors * 4 > n THEN 'failed' ELSE 'success' END AS status, n AS points_written, day FROM
 (SELECT site_id, day, MAX(ts) AS last_ts, COUNT(*) FILTER (event_type = 'error') AS errors, COUNT(*) AS n FROM hits GROUP BY ALL),
 (SELECT unnest(['search', 'web']) AS source) WHERE day(day) % 6 <> 0""",
    ),
    "ledger": (
        ("runs",),
        """SELECT run_id, binding_key, site_id, source, window_start, window_end, started_at, finished_at, status, 'data' AS result_kind,
 CASE WHEN day(window_start) % 5 = 0 THEN window_start + INTERVAL 12 HOURS END AS data_through FROM runs UNION ALL
 SELECT site_id || '|' || source || '|' || kind || '|' || strftime(day, '%Y-%m-%d'), site_id || '|' || source, site_id, source,
 CASE kind WHEN 'again' THEN CAST(day AS TIMESTAMP) - INTERVAL 2 DAYS WHEN 'month' THEN CAST(date_trunc('month', day) AS TIMESTAMP) ELSE TIMESTAMP '2015-01-01' END, CAST(day + 1 AS TIMESTAMP),
 CASE kind WHEN 'years' THEN TIMESTAMP '2015-01-01' ELSE CAST(day AS TIMESTAMP) END, CASE kind WHEN 'years' THEN TIMESTAMP '2023-12-31' ELSE last_ts END,
 CASE kind WHEN 'month' THEN 'failed' ELSE 'success' END, CASE WHEN kind = 'again' AND day(day) % 12 <> 0 THEN 'empty' ELSE 'data' END, NULL
 FROM (SELECT site_id, day, MAX(ts) AS last_ts FROM hits WHERE day(day) % 6 = 0 GROUP BY ALL), (SELECT unnest(['search', 'web']) AS source), (SELECT unnest(['again', 'month', 'years']) AS kind)""",
    ),
    "pair": (
        ("hits",),
        """SELECT site_id, day, CASE WHEN day(day) % 9 <> 0 THEN COUNT(*) FILTER (event_type = 'view') END AS a,
 CASE WHEN day(day) % 7 <> 0 THEN COUNT(*) FILTER (event_type = 'click') END AS b FROM hits WHERE k % 10 < 6 GROUP BY site_id, day""",
    ),
    "forms": (
        (),
        """SELECT c_nationkey AS site, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_orderdate AS DATE) AS day,
 CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status, substr(o_orderpriority, 1, 1) AS form_id, o_orderkey
 FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    "route_edges": (
        ("hits",),
        """SELECT event_id AS link_id, before AS src, route AS dst, CASE event_type WHEN 'view' THEN 'contextual' WHEN 'click' THEN 'related'
 WHEN 'signup' THEN 'action' WHEN 'error' THEN 'utility' ELSE 'menu' END AS layer, day, value FROM
 (SELECT *, lag(route) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM hits)
 WHERE before IS NOT NULL AND value > 25 AND before <> route""",
    ),
    "part_edges": (
        (),
        """SELECT before AS src, l_partkey AS dst, ['menu', 'contextual', 'related', 'action', 'utility', 'breadcrumb'][1 + l_partkey % 6] AS layer FROM
 (SELECT *, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS before FROM lineitem)
 WHERE before IS NOT NULL AND before <> l_partkey""",
    ),
    "bulk": (
        (),
        """SELECT 'site-' || (l_suppkey % 5) AS site_id, CASE WHEN l_linenumber % 2 = 0 THEN 'url_impression' ELSE 'site_impression' END AS namespace,
 CAST(date_trunc('month', l_shipdate) AS DATE) AS data_date, CAST(l_linenumber - 1 AS INTEGER) AS epoch, CAST(l_quantity AS BIGINT) AS impressions,
 CAST(l_quantity AS BIGINT) % 7 AS clicks, CAST(l_extendedprice AS DECIMAL(18,2)) AS position_sum, l_orderkey FROM lineitem""",
    ),
    "inventory": ((), "SELECT source AS site_id, sha256(CAST(doc_id AS VARCHAR)) AS url_hash, doc_id FROM documents"),
    "url_status": (
        (),
        """SELECT sha256(CAST(doc_id AS VARCHAR)) AS url_hash, CASE WHEN quality = 1 THEN 'PASS' ELSE 'FAIL' END AS verdict, quality = 1 AS indexed,
 CAST(DATE '2024-02-01' - CAST(CASE WHEN doc_id % 5 = 0 THEN 40 ELSE doc_id % 20 END AS INTEGER) AS DATE) AS inspected_on FROM labels""",
    ),
    "lanes": (
        (),
        """SELECT 'source' AS lane, '/p/' || (page_id % 97) || '/' AS route, CASE WHEN page_id % 11 = 0 THEN 'redirect' ELSE 'source-only' END AS state, page_id FROM pages WHERE page_id % 2 = 0
 UNION ALL SELECT 'artifact', '/p/' || (page_id % 97) || '/', CASE WHEN page_id % 13 = 0 THEN 'excluded' ELSE 'artifact-only' END, page_id FROM pages WHERE page_id % 3 = 0
 UNION ALL SELECT 'rendered', '/p/' || (page_id % 97) || '/', CASE WHEN page_id % 17 = 0 THEN 'missing' ELSE 'rendered-only' END, page_id FROM pages WHERE page_id % 5 = 0""",
    ),
}


def with_tables(sql: str, *names: str, recursive: bool = False) -> str:
    """sql with the derived tables that it names, and those they need, before it. sql may begin with its own
    tables: `name AS (...), ... SELECT`."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in CTES[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    tables = ", ".join(f"{name} AS ({CTES[name][1]})" for name in order)
    sql = sql.strip()
    start = "WITH RECURSIVE " if recursive else "WITH "
    if not tables:
        return sql if sql.upper().startswith("SELECT") else start + sql
    return f"{start}{tables} {sql}" if sql.upper().startswith("SELECT") else f"{start}{tables}, {sql}"
