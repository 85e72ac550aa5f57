"""Queries that read pages, source texts, redirect lines and spellings, over whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from metriclake.functions import text as fn
from metriclake.operators import evidence
from metriclake.plans.registry import query
from metriclake.plans.text import HOST, PATH
from metriclake.sources.derived import Tables

#: All anchors of the pages at hand, with the part of the page they stand in: their markup has no attribute but href.
PLAIN = """replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&')"""
CUT = "regexp_extract_all(h, '<a href=\"([^\"]*)\">([^<]*)</a>', {})"
ANCHORS = (
    "parts AS (SELECT page_id, 0 AS part, regexp_extract(html, '(?s)^.*?<nav>', 0) AS h FROM pages UNION ALL SELECT page_id, 1, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) FROM pages"
    " UNION ALL SELECT page_id, 2, regexp_extract(html, '(?s)</nav>(.*?)<footer>', 1) FROM pages UNION ALL SELECT page_id, 3, regexp_extract(html, '(?s)<footer>.*$', 0) FROM pages),"
    f" cut AS (SELECT page_id, part, unnest(range(len({CUT.format(1)}))) AS k, unnest({CUT.format(1)}) AS href, unnest({CUT.format(2)}) AS label FROM parts),"
    f" anchors AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY part, k) - 1 AS ordinal, {PLAIN.format('href')} AS href, trim(regexp_replace({PLAIN.format('label')}, '\\s+', ' ', 'g')) AS anchor_text,"
    " CASE part WHEN 1 THEN 'menu' WHEN 3 THEN 'utility' ELSE 'contextual' END AS layer, CASE part WHEN 1 THEN 'navigation' WHEN 3 THEN 'footer' ELSE 'content' END AS landmark FROM cut) "
)
BARE = "regexp_replace(href, '[?#].*$', '')"
SLASHED = f"CASE WHEN {BARE} LIKE '%/' OR contains(regexp_extract({BARE}, '([^/]*)$', 1), '.') THEN {BARE} ELSE {BARE} || '/' END"


def read_pages(t: Tables):
    return evidence.read_pages(t.base("pages"))


@query(
    "html_link_occurrences",
    ANCHORS + f"SELECT page_id, ordinal, href, anchor_text, {SLASHED} AS destination, layer, landmark, layer IN ('menu', 'utility') AS repeated_template, false AS nofollow, true AS crawlable, false AS external, contains(href, '#') AS fragment, CAST(NULL AS VARCHAR) AS action_kind FROM anchors",
)
def _(t: Tables):
    return evidence.link_occurrences(read_pages(t), F.lit("/a/"), ("example.org",)).drop("confidence")


@query("link_layer", ANCHORS + "SELECT layer, landmark, COUNT(*) AS n FROM anchors GROUP BY ALL")
def _(t: Tables):
    return evidence.link_occurrences(read_pages(t), F.lit("/a/"), ("example.org",)).groupBy("layer", "landmark").agg(F.count("*").alias("n"))


def plain(tag: str) -> str:
    inner = PLAIN.format(f"regexp_extract(html, '<{tag}>([^<]*)</{tag}>', 1)")
    return f"trim(regexp_replace({inner}, '\\s+', ' ', 'g'))[:500]"


@query(
    "html_page_facts",
    f"SELECT page_id, {plain('title')} AS title, {plain('h1')} AS h1, '' AS canonical_url, NOT contains(html, 'noindex') AS indexable, '' AS schema_types, len(regexp_extract_all(html, '<a href=[^>]*>[^<]*</a>')) AS n_anchors, len(regexp_extract_all(html, '<form[^>]* action=')) AS n_forms, len(regexp_extract_all(html, '<button[^>]* formaction=')) AS n_buttons FROM pages",
)
def _(t: Tables):
    return evidence.page_facts(read_pages(t)).withColumn("schema_types", F.array_join("schema_types", ","))


@query("json_ld_types", "SELECT doc_id AS page_id, array_to_string(list_sort(list_distinct([x FOR x IN [source, upper(lang), 'Type ' || source] IF x IS NOT NULL])), ',') AS types FROM documents")
def _(t: Tables):
    """Every document as the structured data of a page."""
    author = F.create_map(F.lit("@type"), F.array(F.upper("lang"), F.concat(F.lit("Type "), "source")))
    data = F.to_json(F.struct(F.col("source").alias("@type"), author.alias("author"), F.col("text").alias("articleBody"), F.array(F.struct(F.col("source").alias("@type"))).alias("hasPart")))
    # a script can't hold its own end tag
    html = F.concat(F.lit('<html><head><script type="application/ld+json">'), F.replace(data, F.lit("</"), F.lit("<\\/")), F.lit("</script></head></html>"))
    pages = t.base("documents").select(F.col("doc_id").alias("page_id"), html.alias("html"))
    return evidence.read_pages(pages).select("page_id", F.array_join("schema_types", ",").alias("types"))


CAPTURED = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^http:', 'https:')"
INSIDE = f"regexp_matches({CAPTURED}, '^https://{HOST}(/|$)')"


@query(
    "capture_resolution",
    f"SELECT page_id, CASE WHEN NOT {INSIDE} THEN 'blocked' WHEN contains(url, 'utm_') THEN 'partial' WHEN contains(url, 'page=2') THEN 'failed' ELSE 'complete' END AS capture,"
    f" CASE WHEN NOT {INSIDE} THEN 'unchecked' WHEN contains(url, 'utm_') THEN 'dynamic-unknown' WHEN contains(url, 'page=2') THEN 'unresolved' WHEN url LIKE '%/' THEN 'missing' WHEN url <> {CAPTURED} THEN 'redirect' ELSE 'confirmed-page' END AS resolution FROM pages",
)
def _(t: Tables):
    """Every page's address as it was asked for and as it ended up; its query tells what the server said."""
    final = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^http:", "https:")
    status = F.when(F.col("url").contains("utm_"), None).when(F.col("url").contains("page=2"), 500).when(F.col("url").endswith("/"), 404).otherwise(200)
    found = fn.capture_resolution(F.col("url"), final, status, F.lit(None).cast("string"), F.lit(True), f"https://{HOST}")
    return t.base("pages").withColumn("f", found).select("page_id", F.col("f.capture").alias("capture"), F.col("f.resolution").alias("resolution"))


#: Texts hold no links, so words of whole texts stand as links, in a form by their first letter: (pattern, shown).
CODED = ((r"(\S)[ ]+([aA][a-z]*)", r'\1 href: "/\2"'), (r"(\S)[ ]+([dD][a-z]*)", r"\1 [link](/\2)"), (r"(\S)[ ]+([eE][a-z]*)", r"\1 push('/\2')"), (r"(\S)[ ]+([tT][a-z]*)", r"\1 href={`/\2`}"))


def source_links_sql(text: str, shown: str) -> str:
    """Every quoted string of a line that follows a quote of its kind, by what stands before that quote; and what follows ](."""
    quote = "chr(34) || chr(39) || '`'"
    end = "regexp_extract(before, '([A-Za-z0-9_]+)[[:space:]]*([:=(])[[:space:]]*([{{]?)[[:space:]]*$', {})"
    kinds = " ".join(f"WHEN {test} AND {end.format(1)} IN ({', '.join(repr(n) for n in names)}) THEN '{kind}'" for kind, test, names in (("object-field", f"{end.format(2)} || {end.format(3)} = ':'", fn.LINK_FIELDS), ("jsx-literal", f"{end.format(2)} = '='", fn.LINK_ATTRIBUTES), ("router-literal", f"{end.format(2)} || {end.format(3)} = '('", fn.LINK_CALLS)))
    return (
        f"lines AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS t FROM (SELECT doc_id, string_split({text}, chr(10)) AS l FROM documents)),"
        f" cut AS (SELECT doc_id, line, string_split_regex(t, '[' || {quote} || ']') AS p, regexp_extract_all(t, '[' || {quote} || ']') AS q FROM lines),"
        " strings AS (SELECT doc_id, line, p[i] AS before, p[i + 1] AS value FROM (SELECT *, unnest(range(1, len(q))) AS i FROM cut) WHERE q[i] = q[i + 1]),"
        f" found AS (SELECT doc_id, line, CASE {kinds} END AS source, trim(value, ' ' || chr(9)) AS value, '' AS label FROM strings UNION ALL"
        " SELECT doc_id, line, 'markdown', regexp_extract(m[i + 1], '^[[:space:]]*([^)[:space:]]+)', 1), regexp_extract(m[i], '[[]([^]]*)$', 1) FROM (SELECT doc_id, line, m, unnest(range(1, len(m))) AS i FROM (SELECT doc_id, line, string_split(t, '](') AS m FROM lines)) WHERE regexp_matches(m[i], '[[][^]]*$'))"
        f" {shown.format('(SELECT DISTINCT * FROM found WHERE source IS NOT NULL AND length(value) > 0)')}"
    )


def coded(text: str) -> str:
    for pattern, shown in CODED:
        quoted = shown.replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', '{quoted}', 'g')"
    return text


@query("source_text_links", source_links_sql(coded("text"), "SELECT doc_id, source, COUNT(*) AS n FROM {} GROUP BY ALL"))
def _(t: Tables):
    text = F.col("text")
    for pattern, shown in CODED:
        text = F.regexp_replace(text, pattern, shown.replace("\\1", "$1").replace("\\2", "$2"))
    lines = t.base("documents").select("doc_id", F.posexplode(F.split(text, "\n")).alias("line", "text"))
    return fn.source_links(lines).groupBy("doc_id", "source").agg(F.count("*").alias("n"))


@query("source_links", source_links_sql("text", "SELECT doc_id, CAST(line AS INTEGER) AS line, source, value, label FROM {}"))
def _(t: Tables):
    lines = t.base("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return fn.source_links(lines)


SHOWN = f"CASE WHEN {PATH} LIKE '%/' OR contains(regexp_extract({PATH}, '([^/]*)$', 1), '.') THEN {PATH} ELSE {PATH} || '/' END"


@query(
    "redirect_rules",
    f"SELECT page_id, CASE WHEN NOT contains(url, '#') THEN {SHOWN} END AS source, CASE WHEN contains(url, '#') THEN NULL WHEN contains(url, 'page=') OR url NOT LIKE 'http:%' THEN regexp_replace(url, '[?][^#]*', '') END AS target,"
    " CASE WHEN contains(url, '#') THEN NULL WHEN contains(url, 'page=') THEN 302 ELSE 301 END AS status, CASE WHEN contains(url, '#') THEN 'unparsed' WHEN NOT contains(url, 'page=') AND url LIKE 'http:%' THEN 'unsafe' END AS problem FROM pages WHERE NOT contains(url, 'utm_')",
)
def _(t: Tables):
    """Every page's address in a line of a redirect file: as a comment, a broken, an unsafe or a good rule."""
    path, url = fn.path_of(F.col("url")), F.col("url")
    line = (
        F.when(url.contains("utm_"), F.concat(F.lit("# "), url))
        .when(url.contains("#"), F.concat_ws(" ", url, path))
        .when(url.contains("page="), F.concat(path, F.lit("  "), url, F.lit(" 302")))
        .when(url.startswith("http:"), F.concat(path, F.lit(" javascript:"), url))
        .otherwise(F.concat_ws(" ", path, url))
    )
    return evidence.redirects(t.base("pages").select("page_id", line.alias("line")))


def words_of(t: Tables, normalise, value=None):
    """A normaliser over all words of all documents, or over a column made of them."""
    words = t.base("documents").select(F.explode(F.split("text", "[^A-Za-z0-9]+")).alias("w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    return words.groupBy(normalise(F.col("w") if value is None else value).alias("value")).agg(F.sum("n").alias("n"))


def words_sql(value: str) -> str:
    words = "words AS (SELECT w, COUNT(*) AS n FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z0-9]+')) AS w FROM documents) WHERE w <> '' GROUP BY w)"
    return f"{words} SELECT {value} AS value, CAST(SUM(n) AS BIGINT) AS n FROM words GROUP BY 1"


@query("country_code", words_sql("CASE WHEN regexp_full_match(w, '[A-Za-z]{2}') AND upper(w) NOT IN ('XX', 'ZZ') THEN upper(w) END"))
def _(t: Tables):
    return words_of(t, fn.country_code)


@query("region_code", words_sql("CASE WHEN regexp_full_match(w, '[A-Za-z]{2}[A-Za-z0-9]{1,3}') THEN upper(w[1:2]) || '-' || upper(w[3:]) END"))
def _(t: Tables):
    return words_of(t, fn.region_code, F.concat(F.lit(" "), F.substring("w", 1, 2), F.lit("-"), F.expr("substring(w, 3)")))


@query("language_tag", words_sql("CASE WHEN regexp_full_match(w, '[A-Za-z]{2,3}') THEN lower(w) || '-' || upper(w[1:2]) END"))
def _(t: Tables):
    return words_of(t, fn.language_tag, F.concat("w", F.lit("_"), F.substring("w", 1, 2)))


@query("screen_size", "SELECT value, COUNT(*) AS n FROM (SELECT CASE WHEN p_size >= 10 AND p_retailprice < 1000 THEN CAST(p_size AS VARCHAR) || 'x' || CAST(CAST(floor(p_retailprice) AS INTEGER) AS VARCHAR) END AS value FROM part) GROUP BY 1")
def _(t: Tables):
    """Sizes as reporters write them, from every part's size and price; a price with a fraction is no size."""
    shown = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" X "), F.when(F.col("p_retailprice") < 1000, F.floor("p_retailprice").cast("string")).otherwise(F.format_number("p_retailprice", 2)))
    return t.base("part").groupBy(fn.screen_size(shown).alias("value")).agg(F.count("*").alias("n"))


@query("device_class", "SELECT CASE event_type WHEN 'view' THEN 'desktop' WHEN 'click' THEN 'mobile' WHEN 'signup' THEN 'tablet' ELSE 'other' END AS value, user_id, COUNT(*) AS n FROM events GROUP BY ALL")
def _(t: Tables):
    """The device of each event as its sender spells it."""
    shown = F.expr("CASE event_type WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN ' Laptop' ELSE 'DESKTOP' END WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'Phone ' ELSE 'smartphone' END WHEN 'signup' THEN 'Tablet' ELSE event_type END")
    return t.base("events").groupBy(fn.device_class(shown).alias("value"), "user_id").agg(F.count("*").alias("n"))
