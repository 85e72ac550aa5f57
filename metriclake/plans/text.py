"""Queries that apply the text helpers to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from metriclake.functions import text as fn
from metriclake.operators.coverage import trend_state
from metriclake.operators.facts import point_key
from metriclake.plans.registry import query
from metriclake.sources.derived import Tables

HOST = "thther.example.org"
PATH = "regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '[?#].*$', '')"
STRIP = f"CASE WHEN regexp_replace({PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({PATH}, '/+$', '') END"
PHONE = r"(?:\+?\d[\s().-]*){7,}\d"
EMAIL = r"[^\s/@]+@[^\s/@]+\.[^\s/@]+"


@query("normalize_route", f"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://{HOST}(/|$)') THEN {STRIP} || CASE WHEN contains(url, 'page=2') THEN '?page=2' ELSE '' END END AS route FROM pages")
def _(t: Tables):
    return t.base("pages").select("page_id", fn.normalize_route(F.col("url"), HOST, ("page",)).alias("route"))


@query("canonical_route", f"SELECT page_id, CASE WHEN NOT starts_with(url, 'https://{HOST}/') THEN 'external' WHEN contains(url, 'utm_source') THEN 'unresolved' ELSE 'topology' END AS class, CASE WHEN NOT starts_with(url, 'https://{HOST}/') OR contains(url, 'utm_source') THEN '' WHEN {PATH} LIKE '%.html' OR {PATH} LIKE '%/' THEN {PATH} ELSE {PATH} || '/' END AS route FROM pages")
def _(t: Tables):
    found = fn.canonical_route(F.col("url"), f"https://{HOST}", ("page", "ref"))
    return t.base("pages").select("page_id", found["class"].alias("class"), found["route"].alias("route"))


HREFS = "h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) "


def hrefs(t: Tables):
    return t.base("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


@query("link_destination", HREFS + "SELECT page_id, href, CASE WHEN href LIKE '%/' OR contains(href[2:], '.') THEN href ELSE href || '/' END AS destination FROM h WHERE starts_with(href, '/') AND NOT regexp_matches(href, '[?#]')")
def _(t: Tables):
    found = fn.link_destination(F.col("href"), F.lit("/a/"), ("example.org",))
    return hrefs(t).filter("startswith(href, '/') AND NOT href RLIKE '[?#]'").select("page_id", "href", found["destination"].alias("destination"))


@query("resource_route_filter", HREFS + "SELECT href, CASE WHEN starts_with(href, '/') AND NOT starts_with(href, '//') AND NOT regexp_matches(href, '[\\[\\]{}$*:?#\\s]') AND NOT contains(regexp_extract(href, '([^/]*)$', 1), '.') THEN CASE WHEN href LIKE '%/' THEN href ELSE href || '/' END END AS route FROM h GROUP BY ALL")
def _(t: Tables):
    return hrefs(t).select("href").distinct().select("href", fn.resource_route(F.col("href")).alias("route"))


@query("html_path_to_route", "SELECT page_id, CASE WHEN page_id % 10 = 0 THEN '/p' || page_id || '/' ELSE '/p' || page_id || '/a/' END AS route FROM pages")
def _(t: Tables):
    path = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 10 == 0, "/index.html").otherwise("/a.html"))
    return t.base("pages").select("page_id", fn.html_path_to_route(path).alias("route"))


@query("app_path_to_route", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '/b' || page_id || '/' END AS route FROM pages")
def _(t: Tables):
    n = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 4 == 0, "app/(site)/page.tsx").when(F.col("page_id") % 4 == 1, F.concat(F.lit("src/(x)/b"), n, F.lit("/page.jsx"))).when(F.col("page_id") % 4 == 2, "app/[slug]/page.tsx").otherwise("lib/page.ts")
    return t.base("pages").select("page_id", fn.app_path_to_route(path).alias("route"))


@query("normalize_public_url", f"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://{HOST}') THEN regexp_replace(url, '#.*$', '') END AS url FROM pages")
def _(t: Tables):
    shouted = F.concat(F.upper(F.regexp_extract("url", "^(https?://[^/]*)", 1)), F.regexp_replace("url", "^https?://[^/]*", ""))
    return t.base("pages").select("page_id", fn.normalize_public_url(shouted, HOST).alias("url"))


@query("sitemap_inventory", f"SELECT DISTINCT sha256(regexp_replace(url, '#.*$', '')) AS url_hash FROM pages WHERE regexp_matches(url, '^https?://{HOST}')")
def _(t: Tables):
    docs = t.base("pages").select(F.concat(F.lit("<urlset><url><loc>"), "url", F.lit("</loc></url></urlset>")).alias("xml"))
    locs = docs.select(F.explode(F.regexp_extract_all("xml", F.lit("<loc>([^<]*)</loc>"), F.lit(1))).alias("url"))
    return locs.select(fn.normalize_public_url(F.col("url"), HOST).alias("url")).filter("url IS NOT NULL").select(F.sha2("url", 256).alias("url_hash")).distinct()


@query("sanitize_referrer", f"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://{HOST}(/|$)') THEN {STRIP} END AS route, CASE WHEN regexp_matches(url, '^https?://blog.ththan.example.net(/|$)') THEN 'blog.ththan.example.net' END AS domain FROM pages")
def _(t: Tables):
    found = fn.sanitize_referrer(F.col("url"), HOST, ("blog.ththan.example.net",))
    return t.base("pages").select("page_id", found["route"].alias("route"), found["domain"].alias("domain"))


FIRST_LINE = "split_part(text, chr(10), 1)"
LABEL_OK = f"length(trim({FIRST_LINE})) BETWEEN 1 AND 120 AND NOT contains({FIRST_LINE}, '://') AND NOT regexp_matches({FIRST_LINE}, '{EMAIL}') AND NOT regexp_matches({FIRST_LINE}, '{PHONE}')"


def first_lines(t: Tables):
    return t.base("documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("line"))


@query("safe_label", f"SELECT doc_id, CASE WHEN {LABEL_OK} THEN trim({FIRST_LINE}) END AS label FROM documents")
def _(t: Tables):
    return first_lines(t).select("doc_id", fn.safe_label(F.col("line"), 120).alias("label"))


@query("redact_query", f"SELECT CASE WHEN {LABEL_OK.replace('120', '500')} THEN 'visible' ELSE 'hidden' END AS visibility, COUNT(*) AS n FROM documents GROUP BY 1")
def _(t: Tables):
    return first_lines(t).groupBy(fn.redact_query(F.col("line"))["visibility"].alias("visibility")).agg(F.count("*").alias("n"))


@query("has_direct_identifier", f"SELECT doc_id, regexp_matches(text, '{EMAIL}') OR regexp_matches(text, '{PHONE}') AS found FROM documents")
def _(t: Tables):
    return t.base("documents").select("doc_id", fn.has_direct_identifier(F.col("text")).alias("found"))


@query("has_opaque_identity_route", "SELECT k % 4 AS kind, k % 4 IN (0, 3) AS opaque, COUNT(*) AS n FROM hits GROUP BY ALL", "hits")
def _(t: Tables):
    k = F.col("k").cast("string")
    route = F.expr("CASE k % 4 WHEN 0 THEN concat('/session/abcdef123456-', k) WHEN 1 THEN concat('/blog/abcdef123456-', k) WHEN 2 THEN '/token/product-guide-help' ELSE concat('/x/INVITE/zzzzzzzzzzzz', k) END")
    return t.hits.withColumn("k", F.col("k")).groupBy((F.col("k") % 4).alias("kind"), fn.has_opaque_identity_route(route).alias("opaque")).agg(F.count(k).alias("n"))


@query("safe_domain", "SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain FROM pages")
def _(t: Tables):
    return t.base("pages").select(fn.safe_domain(F.concat(F.lit(" "), F.upper(fn.host_of(F.col("url"))), F.lit(". "))).alias("domain")).distinct()


@query("dimension_normalisers", "SELECT user_id % 5 AS kind, ['DE', NULL, 'FR', NULL, NULL][1 + CAST(user_id % 5 AS INTEGER)] AS country, ['US-CA', NULL, NULL, NULL, NULL][1 + CAST(user_id % 5 AS INTEGER)] AS region, ['en', 'pt-BR', 'zh-Hant', NULL, 'de'][1 + CAST(user_id % 5 AS INTEGER)] AS language, ['1920x1080', NULL, NULL, '800x600', NULL][1 + CAST(user_id % 5 AS INTEGER)] AS screen, ['desktop', 'mobile', 'other', 'tablet', 'desktop'][1 + CAST(user_id % 5 AS INTEGER)] AS device, COUNT(*) AS n FROM hits GROUP BY ALL", "hits")
def _(t: Tables):
    def pick(*values: str):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("user_id") % 5).cast("int") + 1)

    return t.hits.groupBy(
        (F.col("user_id") % 5).alias("kind"),
        fn.country_code(pick(" de", "usa", "FR", "XX", "1")).alias("country"),
        fn.region_code(pick("us-ca", "ca", "x", "", "US")).alias("region"),
        fn.language_tag(pick("EN", "pt_br", "zh-hant", "???", "De")).alias("language"),
        fn.screen_size(pick("1920 x 1080", "0x5", "wide", "800X600", "1x1")).alias("screen"),
        fn.device_class(pick("Laptop", "phone", "tv", "Tablet", "desktop")).alias("device"),
    ).agg(F.count("*").alias("n"))


@query("bounded_number", "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS number, CASE WHEN event_id % 4 <> 3 AND CAST(value AS DECIMAL(18,2)) = floor(CAST(value AS DECIMAL(18,2))) THEN CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS whole FROM events")
def _(t: Tables):
    number = F.col("value").cast("decimal(18,2)").cast("string")
    shown = F.expr("CASE event_id % 4 WHEN 3 THEN concat('-', n) WHEN 2 THEN concat(' ', n) ELSE n END")
    rows = t.base("events").withColumn("n", number).withColumn("s", shown)
    return rows.select("event_id", fn.bounded_number(F.col("s")).cast("double").alias("number"), fn.bounded_number(F.col("s"), integral=True).cast("double").alias("whole"))


@query("parse_provider_day", "SELECT event_id, CASE WHEN day >= DATE '2024-01-05' AND day < DATE '2024-01-20' AND event_id % 5 <> 4 THEN day END AS parsed FROM hits", "hits")
def _(t: Tables):
    shown = F.expr("CASE event_id % 5 WHEN 4 THEN '2024-13-45' WHEN 3 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") WHEN 2 THEN date_format(day, 'yyyyMMdd') ELSE date_format(day, 'yyyy-MM-dd') END")
    return t.hits.select("event_id", fn.parse_provider_day(shown, "2024-01-05", "2024-01-20").alias("parsed"))


@query("parse_provider_hour", "SELECT event_id, CASE WHEN event_id % 3 <> 2 AND day < DATE '2024-01-20' THEN date_trunc('hour', ts) END AS parsed FROM hits", "hits")
def _(t: Tables):
    shown = F.expr("CASE event_id % 3 WHEN 2 THEN date_format(ts, 'yyyyMMddHHmm') WHEN 1 THEN date_format(ts, 'yyyyMMddHH') ELSE concat(date_format(ts, \"yyyy-MM-dd'T'HH\"), ':00') END")
    return t.hits.select("event_id", fn.parse_provider_hour(shown, "2024-01-01", "2024-01-20").alias("parsed"))


@query("site_local_day", "SELECT event_id, CAST(ts + INTERVAL 1 HOUR AS DATE) AS berlin, CAST(ts - INTERVAL 8 HOURS AS DATE) AS pacific FROM hits", "hits")
def _(t: Tables):
    return t.hits.select("event_id", fn.site_local_day(F.col("ts"), "Europe/Berlin").alias("berlin"), fn.site_local_day(F.col("ts"), "America/Los_Angeles").alias("pacific"))


@query("local_day_bounds", "SELECT DISTINCT day, CAST(day AS TIMESTAMP) - INTERVAL 1 HOUR AS start_ts, CAST(day + 1 AS TIMESTAMP) - INTERVAL 1 HOUR AS end_ts FROM hits", "hits")
def _(t: Tables):
    bounds = fn.local_day_bounds(F.col("day"), "Europe/Berlin")
    return t.hits.select("day").distinct().select("day", bounds["start"].alias("start_ts"), bounds["end"].alias("end_ts"))


@query("is_exact_local_day", "SELECT day, day(day) % 2 = 0 AS exact FROM hits GROUP BY day", "hits")
def _(t: Tables):
    start = F.col("day").cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR") + F.when(F.dayofmonth("day") % 2 == 0, F.expr("INTERVAL 0 HOUR")).otherwise(F.expr("INTERVAL 3 HOUR"))
    return t.hits.select("day").distinct().select("day", fn.is_exact_local_day(start, start + F.expr("INTERVAL 24 HOURS"), "Europe/Berlin").alias("exact"))


@query("pretty_page_name", "SELECT DISTINCT route, CASE WHEN k % 2 = 0 THEN 'SEO Guide ' || k ELSE 'My Page' END AS short, CASE WHEN k % 2 = 0 THEN 'S' || (k % 5) || ' / SEO Guide ' || k ELSE 'S' || (k % 5) || ' / My Page' END AS full_name FROM hits", "hits")
def _(t: Tables):
    tail = F.when(F.col("k") % 2 == 0, F.concat(F.lit("seo-guide_"), F.col("k").cast("string"))).otherwise("my--page")
    name = fn.pretty_page_name(F.concat(F.lit("/s"), (F.col("k") % 5).cast("string"), F.lit("/"), tail, F.lit("/")))
    return t.hits.select("route", name["short"].alias("short"), name["full"].alias("full_name")).distinct()


@query("page_id", "SELECT DISTINCT sha256(client_id || chr(0) || site_id || chr(0) || route) AS page_id FROM hits", "hits")
def _(t: Tables):
    return t.hits.select(fn.page_id(F.col("client_id"), F.col("site_id"), F.col("route")).alias("page_id")).distinct()


@query("page_roles", "SELECT DISTINCT route, CASE WHEN route LIKE '/s1/%' AND route LIKE '%5' THEN 'article,landing' WHEN route LIKE '/s1/%' THEN 'article' WHEN route LIKE '%5' THEN 'landing' ELSE '' END AS roles, CASE WHEN route LIKE '%5' THEN 1 WHEN route LIKE '/s1/%' THEN 3 END AS stage FROM hits", "hits")
def _(t: Tables):
    found = fn.page_roles(F.col("route"), [("^/s1/", ["article"], 3), ("5$", ["landing"], 1)])
    return t.hits.select("route").distinct().select("route", F.array_join(found["roles"], ",").alias("roles"), found["stage"].alias("stage"))


@query("route_scope", "SELECT DISTINCT route FROM hits WHERE route LIKE '/s%' AND regexp_matches(route, '^/s[123]/') AND route NOT LIKE '%7'", "hits")
def _(t: Tables):
    return t.hits.select("route").distinct().filter(fn.route_allowed(F.col("route"), ["/s1/*", "/s2/*", "/s3/?*"], ["*7"]))


@query("integral_count", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS DOUBLE) END AS whole FROM events")
def _(t: Tables):
    shown = F.expr("CASE event_id % 3 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN concat(event_id, '.5') ELSE concat(event_id, 'x') END")
    return t.base("events").select("event_id", fn.bounded_number(shown, integral=True).cast("double").alias("whole"))


@query("distance_bucket", "SELECT CASE WHEN k % 7 = 6 AND k % 2 = 0 THEN 'menu-only' WHEN k % 7 = 6 THEN 'unreachable' WHEN k % 7 = 0 THEN 'goal' WHEN k % 7 <= 3 THEN CAST(k % 7 AS VARCHAR) ELSE '4+' END AS bucket, COUNT(*) AS n FROM hits GROUP BY 1", "hits")
def _(t: Tables):
    distance = F.when(F.col("k") % 7 == 6, -1).otherwise(F.col("k") % 7)
    return t.hits.groupBy(fn.distance_bucket(distance, F.col("k") % 2 == 0).alias("bucket")).agg(F.count("*").alias("n"))


@query("trend_state", "SELECT site_id, day, CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN b = 0 AND a <> 0 THEN 'new' WHEN a > b THEN 'better' WHEN a < b THEN 'worse' ELSE 'same' END AS trend FROM pair", "pair")
def _(t: Tables):
    return t.pair.select("site_id", "day", trend_state(F.col("a"), F.col("b")).alias("trend"))


@query("digest_fields", "SELECT user_id, sha256(length(event_type) || ':' || event_type || length(CAST(user_id AS VARCHAR)) || ':' || user_id) AS digest FROM events GROUP BY ALL")
def _(t: Tables):
    return t.base("events").select("user_id", point_key("event_type", "user_id").alias("digest")).distinct()


@query("dims_get", "SELECT route, search_type, COUNT(*) AS n FROM facts GROUP BY ALL", "facts")
def _(t: Tables):
    return t.facts.groupBy(F.col("dims")["route"].alias("route"), F.col("dims")["search_type"].alias("search_type")).agg(F.count("*").alias("n"))
