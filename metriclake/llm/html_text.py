"""Main text of web pages by consensus host paths.

Every page scores its containers and names the best by its generalised path (tags and classes, digits left
out). Spark counts the votes for each path on each host, and every page is read again with the first of its host's
winning paths that holds the article there, or with its own best container where none does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metriclake.llm.arrays import slices
from metriclake.llm.shared import written

TAG = re.compile(r"</?([A-Za-z][^\s/>]*)")
#: The rest of a tag: quotes count after an equals sign only, and only if they are closed.
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
CLASS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Tags by how they are read (fixed values of HTML).
RAW = frozenset("script style noscript template iframe textarea title svg".split())
#: Those of them whose content is markup, so that without their end the page goes on.
MARKUP = frozenset("noscript template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr br math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation".split())
CONTAINERS = frozenset("article main section div td body".split())
DROPPED = frozenset("nav header footer aside form script style noscript template iframe button select menu dialog".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
#: Tags that are never left out by their names, and those whose wrapper can be the page's frame.
NEVER_ASIDE = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
FRAMES = frozenset("form dialog".split())
#: Words that mark an advert inside a line; only these leave out inline elements.
ADVERTS = frozenset("ad ads adv advert advertisement advertising sponsored".split())
#: Words of class, id or role that mark what is not the article: the whole, or all parts of a hyphenated one
#: (then with place words beside them, if it isn't a header's).
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer"
    " header hidden login masthead menu modal nav navbar navigation navi newsletter notice notification pager pagination popup promo promotion"
    " recommended related search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget contentinfo complementary".split()
)
PLACE_WORDS = frozenset("area bar block bottom box container form global group inner items left links list outer panel reader right section site thread top user wrap wrapper".split())


def is_aside(names: list[str]) -> bool:
    """Whether one of the words of class, id or role marks what is not the article."""
    for word in names:
        parts = set(re.split("[-_]+", word))
        marks = parts & ASIDE_WORDS
        if marks == parts or (marks - {"header", "footer"} and parts <= ASIDE_WORDS | PLACE_WORDS):
            return True
    return False


class Page:
    """Blocks of text of a page, each with its nearest container; containers with paths and parents.

    The page is read once from start to end; of open elements only blocks are stacked, each with a count of the
    inline ones open in it, and paths are numbers, so that broken or deeply nested pages take linear time too.
    """

    def __init__(self, html: str) -> None:
        self.parents: list[int] = [-1]
        self.tags: list[str] = ["body"]
        self.path_of: list[int] = [0]  # of each container, the number of its path
        self.steps: dict[tuple[int, str], int] = {}  # (path, last step) -> path
        self.labels: list[tuple[int, str]] = [(-1, "body")]  # of each path, the path before and the last step
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        # elements left out: the next one around each (-1: none), whether it may be the page's frame
        self.asides: list[tuple[int, bool]] = []
        self._outs: list[int] = []  # of each block, the innermost element left out around it
        self._starts: list[int] = []  # the same of each start of the article (h1, main, article)
        self._read(html)
        self._leave_out()

    def path(self, container: int) -> str:
        """The steps of a container's path from body on, joined by >."""
        found, at = [], self.path_of[container]
        while at >= 0:
            at, label = self.labels[at]
            found.append(label)
        return ">".join(reversed(found))

    def _with_path(self, path: str | None) -> set[int]:
        """The containers with this path."""
        at = 0
        for label in (path or "").split(">")[1:]:
            if (at, label) not in self.steps:
                return set()
            at = self.steps[at, label]
        return {i for i, p in enumerate(self.path_of) if p == at} if path else set()

    def _leave_out(self) -> None:
        """Drop the blocks in elements left out, but for an element that holds most of the page's unlinked text
        and the first start of its article, or all of a page that shows no start."""
        held = [0] * len(self.asides)
        total = 0
        for (_, text, linked), out in zip(self.blocks, self._outs, strict=True):
            worth = max(0, len(text) - linked)
            total += worth
            if out >= 0:
                held[out] += worth
        for i in range(len(held) - 1, -1, -1):  # inner ones come last
            if self.asides[i][0] >= 0:
                held[self.asides[i][0]] += held[i]
        frames: list[bool] = []  # whether an element and all left out around it may be frames
        for parent, frame in self.asides:
            frames.append(frame and (parent < 0 or frames[parent]))
        first: set[int] | None = None
        for out in self._starts:
            if out < 0 or frames[out]:
                first = set()
                while out >= 0:
                    first.add(out)
                    out = self.asides[out][0]
                break
        gone: list[bool] = []
        for i, (parent, frame) in enumerate(self.asides):
            kept = frame and 2 * held[i] > total and (first is None or i in first)
            gone.append(not kept or (parent >= 0 and gone[parent]))
        self.blocks = [block for block, out in zip(self.blocks, self._outs, strict=True) if out < 0 or not gone[out]]

    def _read(self, html: str) -> None:
        # of each open block element: tag, its container, the innermost element left out around it (-1: none),
        # and how many inline elements of each tag are open in it
        stack: list[tuple[str, int, int, dict[str, int]]] = [("", 0, -1, {})]
        opened: dict[str, int] = {}  # block elements by tag
        pieces: list[str] = []
        linked = links = 0  # characters in links of this block; links open now
        at, n, broken = 0, len(html), False
        unclosed: set[str] = set()  # of MARKUP, those that have no end from here on
        advert, muted = "", 0  # the inline element left out here, and how many of its tag are open since

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.blocks.append((stack[-1][1], text, linked))
                    self._outs.append(stack[-1][2])
                pieces.clear()
            linked = 0

        def leave() -> None:
            nonlocal links
            tag, _, _, inline = stack.pop()
            opened[tag] -= 1
            links -= inline.get("a", 0)

        def show(raw: str) -> None:
            nonlocal linked
            if raw and not advert:
                text = unescape(raw)
                pieces.append(text)
                if links > 0:
                    linked += len(text)

        shown = 0  # up to here the page is read
        while (at := html.find("<", at)) >= 0:
            found = TAG.match(html, at)
            if not found:
                if html.startswith(("<!", "<?"), at):
                    show(html[shown:at])
                    end = html.find("-->", at + 4) + 2 if html.startswith("<!--", at) else html.find(">", at)
                    at = shown = end + 1 if end > at else n
                else:
                    at += 1  # a mark of the text
                continue
            show(html[shown:at])
            closing, tag = html[at + 1] == "/", found[1].lower()
            rest = None if broken else REST.match(html, found.end())
            if not rest:  # all later > are in quotes: from here on quotes don't count
                broken = True
            end = rest.end() if rest else html.find(">", found.end()) + 1
            if not end:
                shown = n
                break
            attributes = html[found.end() : end - 1]
            at = shown = end
            if closing:
                if tag in INLINE:  # an inline end closes in the nearest block only
                    if tag == advert:
                        muted -= 1
                        advert = advert if muted else ""
                    inline = stack[-1][3]
                    if tag not in VOID and inline.get(tag):
                        inline[tag] -= 1
                        links -= tag == "a"
                    continue
                advert = ""
                if tag == "p":
                    flush()
                if tag in VOID or not opened.get(tag):
                    continue
                flush()
                while stack[-1][0] != tag:
                    leave()
                leave()
                continue
            ended = attributes.rstrip().endswith("/")
            if tag in RAW:
                if not ended and tag not in unclosed:
                    close = re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*>", re.I).search(html, at)
                    if not close and tag in MARKUP:
                        unclosed.add(tag)
                    else:
                        at = shown = close.end() if close else n
                continue
            if tag in VOID:
                if tag == "br":
                    pieces.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in INLINE:
                if not advert and any(w in ADVERTS for _, b, c, d in CLASS.findall(attributes) for w in (b or c or d).lower().split()):
                    advert = tag
                    muted = 0
                muted += tag == advert
                inline = stack[-1][3]
                inline[tag] = inline.get(tag, 0) + 1
                links += tag == "a"
                continue
            advert = ""  # it ends with its line at the latest
            flush()
            for depth in (1, 2):  # the elements that a start of this tag ends
                if len(stack) > depth and tag in CLOSED_BY.get(stack[-depth][0], ()):
                    for _ in range(depth):
                        leave()
                    break
                if stack[-1][0] != "p":
                    break
            container, out = stack[-1][1], stack[-1][2]
            names = [(a.lower(), (b or c or d).lower()) for a, b, c, d in CLASS.findall(attributes)]
            named = tag not in NEVER_ASIDE and is_aside([w for _, value in names for w in value.split()])
            inside = opened.get("article", 0) + opened.get("main", 0) > 0
            dropped = tag in DROPPED and not (tag in ("header", "figcaption") and inside)
            if dropped or named:
                self.asides.append((out, not dropped or tag in FRAMES))
                out = len(self.asides) - 1
            if tag in ("h1", "main", "article"):
                self._starts.append(out)
            if tag in CONTAINERS and tag != "body":
                classes = sorted({re.sub(r"[\d>]+", "", w) for a, value in names if a == "class" for w in value.split()})
                step = (self.path_of[container], ".".join([tag, *classes]))
                if step not in self.steps:
                    self.steps[step] = len(self.labels)
                    self.labels.append(step)
                self.path_of.append(self.steps[step])
                self.parents.append(container)
                self.tags.append(tag)
                container = len(self.parents) - 1
            if not ended or tag not in ("div", "p"):
                stack.append((tag, container, out, {}))
                opened[tag] = opened.get(tag, 0) + 1
        show(html[shown:])
        flush()

    def best(self) -> tuple[int, float]:
        """(container, score): text outside links counts for its nearest container, half for the next; of
        containers inside an article or main element that element stands for all."""
        scores = [0.0] * len(self.parents)
        for container, text, linked in self.blocks:
            worth = max(0, len(text) - 2 * linked)
            while container >= 0 and worth > 1:
                scores[container] += worth
                container, worth = self.parents[container], worth / 2
        best = max(range(len(scores)), key=lambda i: (scores[i], -i))
        found, up = best, best
        while up >= 0:
            if self.tags[up] in ("article", "main"):
                found = up
                if self.tags[up] == "article":
                    break
            up = self.parents[up]
        return found, scores[best]

    def _inside(self, chosen: set[int]) -> list[bool]:
        """Of each container, whether it is one of the chosen or inside one."""
        inside = [False] * len(self.parents)
        for i, parent in enumerate(self.parents):  # parents come first
            inside[i] = i in chosen or (parent >= 0 and inside[parent])
        return inside

    def _worth(self, inside: list[bool]) -> int:
        return sum(max(0, len(text) - 2 * linked) for container, text, linked in self.blocks if inside[container])

    def text(self, *paths: str | None) -> str:
        """Blocks of the containers with the first of these paths that holds enough of the page, or of the best container.

        Enough is half of the unlinked text of the page's own best container, or a quarter where all containers of the path are
        inside that one and so may leave out what doesn't belong to the article."""
        inside = own = self._inside({self.best()[0]})
        for path in paths:
            if chosen := self._with_path(path):
                found = self._inside(chosen)
                if (4 if all(own[i] for i in chosen) else 2) * self._worth(found) >= max(1, self._worth(own)):
                    inside = found
                    break
        return "\n\n".join(text for container, text, _ in self.blocks if inside[container])


#: Paths of a host that its pages are tried with, by votes; pages that none of them fits go by their own best container.
PATHS = 3
#: So many hosts at most have their paths broadcast (a row each); more are joined by a shuffle.
BROADCAST_HOSTS = 100_000


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the PATHS paths with most votes of each host, then most text, then first by name."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            rows = []
            for html in batch.column(1).to_pylist():
                page = Page(html or "")
                node, score = page.best()
                rows.append((page.path(node) if score > 0 else None, score))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["host", "path", "score"])

    found = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).filter("host IS NOT NULL").mapInArrow(votes, "host string, path string, score double")
    counts = found.filter("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.desc("score"), "path")
    best = counts.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= PATHS)
    return best.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("k", "path"))).alias("found")).select("host", F.col("found.path").alias("paths"))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html).

    A null html, or one without an article, has an empty text. A null url, or one without a host, has no
    votes: the page's own best container counts. Repeated rows stay. Other columns are not read.
    """
    paths = written(host_paths(pages), "host_paths")
    few = paths.count() <= BROADCAST_HOSTS
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"), F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"))
    joined = rows.join(F.broadcast(paths) if few else paths, "host", "left").select("page_id", "html", "url", "paths")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            found = [Page(html or "").text(*(paths or [])) for html, paths in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
