"""Sitemaps that landed as XML documents: the tree below each site's root document, and the pages that it lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metriclake.functions import text
from metriclake.sources.shared import materialised

#: Contract: levels of documents below the root.
LEVELS = 4
# The root elements of the format, with our name of their kind.
KINDS = {"sitemapindex": "index", "urlset": "urlset"}


def contents(xml: str | None) -> tuple[str, list[str]]:
    """Kind (index, urlset, invalid) and locations of a document. Documents that declare a type or entities, and those
    with another root element, are invalid and have no locations."""
    if not xml or "<!DOCTYPE" in (shouted := xml.upper()) or "<!ENTITY" in shouted:
        return "invalid", []
    parser = ElementTree.XMLPullParser(("start", "end"))
    names, found = [], []
    try:
        parser.feed(xml)
        parser.close()
        for event, element in parser.read_events():
            name = element.tag.rpartition("}")[2].lower()
            if event == "start":
                names.append(name)
            elif name == "loc" and element.text and element.text.strip():
                found.append(element.text.strip())
    except (ElementTree.ParseError, ValueError):
        return "invalid", []
    kind = KINDS.get(names[0], "invalid")
    return kind, found if kind != "invalid" else []


def read_documents(documents: DataFrame) -> DataFrame:
    """documents (url, xml) -> url, c (kind, locations)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [contents(x) for x in batch["xml"]]
            yield pd.DataFrame({"url": batch["url"], "kind": [k for k, _ in found], "locations": [x for _, x in found]})

    return documents.mapInPandas(read, "url string, kind string, locations array<string>").select("url", F.struct("kind", "locations").alias("c"))


def sitemap_tree(sites: DataFrame, documents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """sites (site_id, root_url), documents (url, xml) -> a row for each document that a site's root reaches.

    Columns: site_id, host, url, level (of the shortest way from the root), kind (index, urlset, invalid, missing), locations
    (normalised, each once, those on the site's host only), problem (missing, invalid, too_deep for an index on the last
    level, foreign for locations of another host; else null). Documents are read once; each level is a join of
    what the level before listed, less what was seen, so repeated and cyclic indexes are read once a site. A URL that landed
    twice counts with the smaller of its contents; null URLs are left out; a site without a root URL has no rows.
    """
    url = text.normalize_public_url(F.col("url"), text.host_of(F.col("url")))
    landed = documents.select(url.alias("url"), "xml").filter("url IS NOT NULL")
    read = materialised(read_documents(landed).groupBy("url").agg(F.min("c").alias("c")))
    host = text.host_of(F.col("root_url"))
    roots = sites.select("site_id", host.alias("host"), text.normalize_public_url(F.col("root_url"), host).alias("url"), F.lit(0).alias("level"))
    new = seen = materialised(roots.filter("url IS NOT NULL").distinct())
    reached: list[DataFrame] = []
    for level in range(levels + 1):
        own = F.array_distinct(F.transform("c.locations", lambda x: text.normalize_public_url(x, F.col("host"))))
        foreign = F.array_contains(F.transform(own, lambda x: x.isNull()), True)
        found = new.join(read, "url", "left").select("site_id", "host", "url", "level", F.coalesce("c.kind", F.lit("missing")).alias("kind"), F.coalesce(F.filter(own, lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("locations"), F.coalesce(foreign, F.lit(False)).alias("foreign"))
        too_deep = (F.col("kind") == "index") & F.lit(level == levels)
        problem = F.when(F.col("kind").isin("missing", "invalid"), F.col("kind")).when(too_deep, "too_deep").when(F.col("foreign"), "foreign")
        reached.append(materialised(found.withColumn("problem", problem).drop("foreign")))
        if level == levels:
            break
        listed = reached[-1].filter("kind = 'index'").select("site_id", "host", F.explode("locations").alias("url")).distinct()
        new = materialised(listed.join(seen, ["site_id", "url"], "left_anti").select("site_id", "host", "url", F.lit(level + 1).alias("level")))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return reduce(DataFrame.unionByName, reached)


def inventory(tree: DataFrame) -> DataFrame:
    """site_id, url_hash, level, complete: the different pages of each site's tree, by hash, with the first level that lists
    them. complete: no document of the site has a problem, so a page that isn't here isn't listed."""
    state = tree.groupBy("site_id").agg((F.count("problem") == 0).alias("complete"))
    pages = tree.filter("kind = 'urlset'").select("site_id", "level", F.explode("locations").alias("url"))
    return pages.groupBy("site_id", F.sha2("url", 256).alias("url_hash")).agg(F.min("level").alias("level")).join(state, "site_id")
