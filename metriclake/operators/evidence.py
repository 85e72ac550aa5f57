"""Evidence read from pages and redirect files: links with their surroundings, page facts, structured data.

A task turns each page into a flat list of the elements that matter, in order, each with the place at which it ends; what
stands around a link, labels, titles and facts are then Spark columns over that list.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metriclake.functions import text

#: Contract: destinations, link texts, titles and names of types are kept to so many characters.
HREF, LABEL, TITLE, TYPE = 4000, 2000, 500, 120
#: Bytes of pages that a task reads at once, about; one page at least.
AT_ONCE = 1 << 22
# Elements without content in HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that are listed; others are if they have one of the marks. Those that can stand around a link, those whose text is kept.
LANDMARKS = ("nav", "header", "footer", "main", "aside", "article")
MARKS = ("aria-label", "data-related-content", "data-cta")
LISTED = frozenset(("a", "form", "button", "title", "h1", "script", "meta", "link", *LANDMARKS))
SPOKEN = frozenset(("a", "title", "h1", "script"))
ELEMENT = "struct<at: int, until: int, tag: string, has: map<string,string>, said: array<string>>"
_ELEMENT = pa.struct([("at", pa.int32()), ("until", pa.int32()), ("tag", pa.string()), ("has", pa.map_(pa.string(), pa.string())), ("said", pa.list_(pa.string()))])


#: Character references, which count only if they are closed: what was cut off inside one, or a query's "&copy=", stays as it is.
REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def decoded(raw: str) -> str:
    """raw with its closed character references decoded."""
    return REFERENCE.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], raw) if "&" in raw else raw


class Tokens(HTMLParser):
    """What a page holds, in order: (tag, attributes), (tag, None) for an end, and texts."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list = []
        self.handle_data = lambda text: self.found.append(decoded(text))
        self.handle_endtag = lambda tag: self.found.append((tag, None))
        self.handle_starttag = self.handle_startendtag = lambda tag, attrs: self.found.append((tag, {k: decoded(v or "") for k, v in attrs}))
        # the parser would decode open references as well; so it gets each "&" as a reference, and gives back the raw text (or, of scripts and
        # styles, which it doesn't decode, these references, which are decoded to the raw text)
        self.feed(html.replace("&", "&amp;"))
        self.close()


class Listing:
    """The listed elements of a page, each {at, until, tag, has, said}: `at` numbers them, at + 1 ... until - 1 lie inside.

    One scan, linear in the page. An end tag ends its element and what was left open inside it, and is nothing where none
    is open; a link ends where the next begins; what is never closed lasts to the end of the page.
    """

    def __init__(self, html: str) -> None:
        self.found: list[dict] = []
        self._open: list[tuple[str, int]] = []  # tag and number (-1: not listed) of each open element
        self._depths: defaultdict[str, list[int]] = defaultdict(list)  # where each tag is open
        self._speaking: dict[int, list[str]] = {}
        for token in Tokens(html).found:
            if isinstance(token, str):
                for said in self._speaking.values():  # at most one an element of SPOKEN that is open
                    said.append(token)
            elif token[1] is None:
                self._leave(token[0])
            else:
                self._enter(*token)
        for _, at in self._open:
            self._finish(at)

    def _enter(self, tag: str, has: dict[str, str]) -> None:
        at = -1
        if tag in SPOKEN:  # none of them holds another of its kind
            for other in [k for k in self._speaking if self.found[k]["tag"] == tag]:
                self._finish(other)
        if tag in LISTED or any(m in has for m in MARKS):
            at = len(self.found)
            self.found.append({"at": at, "until": -1 if tag not in VOID else at + 1, "tag": tag, "has": list(has.items()), "said": []})
            if tag in SPOKEN:
                self._speaking[at] = self.found[at]["said"]
        if tag not in VOID:
            self._depths[tag].append(len(self._open))
            self._open.append((tag, at))

    def _leave(self, tag: str) -> None:
        if self._depths[tag]:
            depth = self._depths[tag][-1]
            while len(self._open) > depth:
                inner, at = self._open.pop()
                self._depths[inner].pop()
                self._finish(at)

    def _finish(self, at: int) -> None:
        if at >= 0 and self.found[at]["until"] < 0:
            self.found[at]["until"] = len(self.found)
            self._speaking.pop(at, None)


def types_in(raw: str) -> set[str]:
    """The names that any object of a JSON text gives as its @type, alone or in a list; none if the text isn't JSON."""
    names: list = []
    try:
        json.loads(raw, object_pairs_hook=lambda pairs: names.extend(v for k, v in pairs if k == "@type"))
    except (ValueError, RecursionError):
        return set()
    return {n[:TYPE] for v in names for n in (v if isinstance(v, list) else [v]) if isinstance(n, str)}


def listed(pages: DataFrame) -> DataFrame:
    """page_id, elements (see Listing), schema_types (of JSON-LD scripts, in order of name) of pages (page_id, html)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
            first = 0
            while first < len(ends):
                last = max(first + 1, int(ends.searchsorted(ends[first] + AT_ONCE)))
                part = batch.slice(first, last - first)
                found = [Listing(html or "").found for html in part.column(1).to_pylist()]
                types = [sorted(set().union(*(types_in("".join(e["said"])) for e in page if e["tag"] == "script" and dict(e["has"]).get("type", "").lower() == "application/ld+json"))) for page in found]
                kept = [[e | {"said": []} if e["tag"] == "script" else e for e in page] for page in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.list_(_ELEMENT)), pa.array(types, pa.list_(pa.string()))], names=["page_id", "elements", "schema_types"])
                first = last

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(read, f"page_id long, elements array<{ELEMENT}>, schema_types array<string>")


def spoken(element: Column, between: str, limit: int) -> Column:
    """An element's text with single spaces, at most `limit` characters of it."""
    return F.substring(F.trim(F.regexp_replace(F.array_join(element["said"], between), r"(?U)\s+", " ")), 1, limit)


def read_pages(pages: DataFrame, explicit: str = "data-link-layer") -> DataFrame:
    """page_id, title (the last), h1 (the first with a text), canonical_url (the last), indexable, schema_types and links of each of
    pages (page_id, html). A null page has nothing and is indexable. Links are anchors with href, forms with an action and
    buttons with a formaction, in the order of their starts, with what stands around them."""

    def all_of(*tags: str) -> Column:
        return F.filter("elements", lambda e: e["tag"].isin(*tags))

    def attribute(e: Column, name: str) -> Column:
        return F.coalesce(e["has"][name], F.lit(""))

    def words(e: Column, name: str) -> Column:
        return F.filter(F.split(F.lower(attribute(e, name)), r"\s+"), lambda w: w != "")

    def last_of(found: Column) -> Column:
        return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))

    canonical = F.filter(all_of("link"), lambda e: F.array_contains(words(e, "rel"), "canonical"))
    hidden = F.exists(all_of("meta"), lambda e: F.lower(attribute(e, "name")).isin("robots", "googlebot") & F.arrays_overlap(F.transform(F.split(F.lower(attribute(e, "content")), ","), lambda x: F.trim(x)), F.array(F.lit("noindex"), F.lit("none"))))
    headings = F.filter(F.transform(all_of("h1"), lambda e: spoken(e, "", TITLE)), lambda x: x != "")
    target = {"a": "href", "form": "action", "button": "formaction"}
    where = F.filter("elements", lambda e: (e["until"] > e["at"] + 1) & (e["tag"].isin(*LANDMARKS) | F.exists(F.array(*map(F.lit, MARKS)), lambda m: F.map_contains_key(e["has"], m))))

    def link(e: Column) -> Column:
        around = F.filter("_where", lambda w: (w["at"] < e["at"]) & (w["until"] > e["at"]))
        kind = F.when(e["tag"] == "a", "anchor").otherwise(e["tag"])
        href = F.coalesce(*[F.when(e["tag"] == tag, e["has"][name]) for tag, name in target.items()])
        return F.struct(
            kind.alias("element"),
            F.substring(href, 1, HREF).alias("href"),
            F.when(e["tag"] == "a", spoken(e, " ", LABEL)).otherwise("").alias("label"),
            e["has"][explicit].alias("explicit"),
            F.array_sort(F.array_distinct(F.transform(around, lambda w: w["tag"]))).alias("ancestors"),
            F.array_join(F.transform(around, lambda w: attribute(w, "aria-label")), " ").alias("aria"),
            F.exists(around, lambda w: F.map_contains_key(w["has"], "data-related-content")).alias("related"),
            (F.map_contains_key(e["has"], "data-cta") | F.exists(around, lambda w: F.map_contains_key(w["has"], "data-cta"))).alias("action"),
            words(e, "rel").alias("rel"),
        )

    linking = F.filter("elements", lambda e: ((e["tag"] == "a") & e["has"]["href"].isNotNull()) | F.coalesce(F.when(e["tag"] == "form", e["has"]["action"] != "").when(e["tag"] == "button", e["has"]["formaction"] != ""), F.lit(False)))
    return listed(pages).withColumn("_where", where).select(
        "page_id",
        last_of(F.transform(all_of("title"), lambda e: spoken(e, "", TITLE))).alias("title"),
        F.coalesce(F.get(headings, F.lit(0)), F.lit("")).alias("h1"),
        last_of(F.transform(canonical, lambda e: F.substring(attribute(e, "href"), 1, HREF))).alias("canonical_url"),
        (~hidden).alias("indexable"),
        "schema_types",
        F.transform(linking, link).alias("links"),
    )


def link_occurrences(read: DataFrame, route: Column, hosts: tuple[str, ...]) -> DataFrame:
    """One row per anchor of read pages, by its ordinal on the page: where it leads, what it says, in which layer
    and landmark it stands, and whether it can be followed. route is the page's own."""
    each = read.select("page_id", route.alias("route"), F.posexplode(F.filter("links", lambda x: x["element"] == "anchor")).alias("ordinal", "link"))
    layer = text.link_layer(F.col("link.explicit"), F.col("link.ancestors"), F.col("link.aria"), F.col("link.related"), F.col("link.action"))
    found = text.link_destination(F.col("link.href"), F.col("route"), hosts)
    nofollow = F.array_contains("link.rel", "nofollow")
    out = each.select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "link.href", F.col("link.label").alias("anchor_text"), layer.alias("l"), found.alias("d"), nofollow.alias("nofollow"))
    action = F.coalesce(F.col("d.action"), F.when(F.col("l.layer") == "action", "cta"))
    return out.select(
        "page_id", "ordinal", "href", "anchor_text", F.col("d.destination").alias("destination"), "l.layer", "l.landmark", "l.confidence", F.col("l.layer").isin("menu", "utility").alias("repeated_template"), "nofollow", (~F.col("nofollow")).alias("crawlable"), "d.external", "d.fragment", action.alias("action_kind")
    )


def page_facts(read: DataFrame) -> DataFrame:
    """Each read page's facts with the number of its links by element."""

    def count(element: str) -> Column:
        return F.size(F.filter("links", lambda x: x["element"] == element)).cast("long")

    return read.select("page_id", "title", "h1", "canonical_url", "indexable", "schema_types", count("anchor").alias("n_anchors"), count("form").alias("n_forms"), count("button").alias("n_buttons"))


def redirects(lines: DataFrame) -> DataFrame:
    """Rules of redirect files, lines (line string and any other columns): source, target, status, problem.

    Blank lines and comments are left out. A rule is a source route, a destination and perhaps a status (301 unless
    it says another); problem is unparsed (no destination, or a source that is no route of the site) or
    unsafe (a destination with another scheme, a host without a name, credentials, or odd characters), with no target.
    """
    parts = F.split(F.trim("line"), r"\s+")
    rows = lines.filter("trim(line) <> '' AND NOT startswith(ltrim(line), '#')").withColumn("_p", parts)
    source, target = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    parsed = target.isNotNull() & source.startswith("/") & ~source.startswith("//")
    scheme = F.lower(F.regexp_extract(target, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    safe = ~target.rlike(r"[\\\x00-\x1f]|%(?![0-9A-Fa-f]{2})") & (target.rlike("^/(?!/)") | (scheme.isin("http", "https") & target.rlike("^[A-Za-z]+://[^/?#@]+(?:[/?#]|$)")))
    clean = F.concat(F.lower(F.regexp_extract(target, "^([A-Za-z]+://[^/?#]*)", 1)), F.regexp_replace(F.regexp_replace(target, "^[A-Za-z]+://[^/?#]*", ""), r"\?[^#]*", ""))
    status = F.coalesce(F.regexp_extract(F.get("_p", F.lit(2)), "^([0-9]{3})!?$", 1).try_cast("int"), F.lit(301))
    problem = F.when(~parsed, "unparsed").when(~safe, "unsafe")
    route = text.resource_route(source)
    return rows.select(*lines.columns, F.when(parsed, F.coalesce(route, source)).alias("source"), F.when(problem.isNull(), clean).alias("target"), F.when(parsed, status).alias("status"), problem.alias("problem")).drop("line")
