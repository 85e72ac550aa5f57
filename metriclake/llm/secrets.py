"""Secret scans with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query of trigrams that any match must hold is derived by walking its
parse tree. Posting lists of the queries' trigrams are kept by blocks of rows; each query intersects and unites them,
and its rule runs only over the candidates. Rules without a mandatory trigram scan every document.
"""

from __future__ import annotations

import re._parser as regex
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metriclake.llm.shared import row_key


@dataclass(frozen=True)
class Rule:
    """A regular expression that Java, Python and RE2 read alike.

    kept: the group whose length decides, and its least length; a shorter match is found, then dropped.
    """

    kind: str
    pattern: str
    kept: tuple[int, int] = (0, 1)


def either_case(literal: str) -> str:
    """A literal whose letters (A-Z) are there in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in literal)


#: The base kinds in their order, then the added ones (public token formats; fixed values).
BASE = (
    Rule("assign", "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", kept=(2, 6)),
    Rule("access", "AKIA[A-Z0-9]+", kept=(0, 20)),
    Rule("hex", "[0-9a-f]+", kept=(0, 24)),
)
ADDED = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("code_host", "(?:ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9]{36}"),
    Rule("chat", "(?:xoxb-|xoxp-|xoxa-|xoxr-|xoxs-)[A-Za-z0-9-]{10,}"),
    Rule("maps_key", "AIza[A-Za-z0-9_-]{35}"),
    Rule("bearer", either_case("bearer ") + "[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("url_login", r"://[A-Za-z0-9._-]+:[^\x20\x09-\x0D@/]{3,}@"),
)
#: A private key's parts, for redaction: line ends (real or written out), its END line, header lines, base64 text. Words of base64 of under
#: SHORT characters are no key's, but for the last of a key. None of these expressions repeats a group, so none recurs.
ENDS, SHORT = r"(?<=\n)|(?<=\\n)", 16
KEY_END = "-----END [A-Z ]{0,20}PRIVATE KEY-----"

#: A query is True (anything), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple[str, frozenset]
#: Strings that a part of an expression is spelled out to, and members of a class that is spelled out.
SPELLED, MEMBERS = 64, 10


def _both(*queries: Query) -> Query:
    asked = frozenset(q for x in queries if x is not True for q in (x[1] if isinstance(x, tuple) and x[0] == "and" else [x]))
    return True if not asked else next(iter(asked)) if len(asked) == 1 else ("and", asked)


def _any(*queries: Query) -> Query:
    if True in queries:
        return True
    asked = frozenset(q for x in queries for q in (x[1] if isinstance(x, tuple) and x[0] == "or" else [x]))
    asked = frozenset(q for q in asked if not any(other != q and trigrams(other) <= trigrams(q) and "or" not in (other[0], q[0]) for other in asked))
    return next(iter(asked)) if len(asked) == 1 else ("or", asked)


def _of_strings(strings: frozenset[str]) -> Query:
    """All trigrams of one of the strings."""
    if not strings or min(map(len, strings)) < 3:
        return True
    return _any(*[_both(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


@dataclass(frozen=True)
class Part:
    """What is known of the matches of a part: all of them if they are few, else how they begin and end; and a query."""

    exact: frozenset[str] | None
    begin: frozenset[str]
    end: frozenset[str]
    query: Query = True

    @staticmethod
    def of(strings: frozenset[str]) -> Part:
        return Part(strings, strings, strings)

    def then(self, other: Part) -> Part:
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= SPELLED:
            return Part.of(frozenset(a + b for a, b in product(self.exact, other.exact)))
        own = [_of_strings(x.exact) if x.exact is not None else x.query for x in (self, other)]
        across = [a + b for a, b in product(self.end, other.begin)] if len(self.end) * len(other.begin) <= SPELLED else [""]
        begin = frozenset(a + b for a, b in product(self.exact, other.begin)) if self.exact is not None and len(self.exact) * len(other.begin) <= SPELLED else self.begin
        end = frozenset(a + b for a, b in product(self.end, other.exact)) if other.exact is not None and len(self.end) * len(other.exact) <= SPELLED else other.end
        return Part(None, begin, end, _both(*own, _of_strings(frozenset(across))))

    def inexact(self) -> Part:
        return self if self.exact is None else Part(None, self.begin, self.end, _of_strings(self.exact))


NOTHING, ANYTHING = Part.of(frozenset([""])), Part(None, frozenset([""]), frozenset([""]))


def _class(members: list) -> frozenset[str] | None:
    """The characters of a class, folded; None if they are many."""
    found: set[str] = set()
    for kind, value in members:
        if kind is regex.LITERAL:
            found.add(chr(value).lower())
        elif kind is regex.RANGE and value[1] - value[0] < MEMBERS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(found) if len(found) <= MEMBERS else None


def _part(tokens) -> Part:
    out = NOTHING
    for kind, value in tokens:
        if kind is regex.LITERAL:
            one = Part.of(frozenset([chr(value).lower()]))
        elif kind is regex.IN and (members := _class(value)):
            one = Part.of(members)
        elif kind in (regex.AT, regex.ASSERT, regex.ASSERT_NOT):
            one = NOTHING
        elif kind is regex.SUBPATTERN:
            one = _part(value[-1])
        elif kind is regex.ATOMIC_GROUP:
            one = _part(value)
        elif kind is regex.BRANCH:
            ways = [_part(x) for x in value[1]]
            if all(w.exact is not None for w in ways) and sum(len(w.exact) for w in ways) <= SPELLED:
                one = Part.of(frozenset().union(*[w.exact for w in ways]))
            else:
                ways = [w.inexact() for w in ways]
                one = Part(None, frozenset().union(*[w.begin for w in ways]), frozenset().union(*[w.end for w in ways]), _any(*[w.query for w in ways]))
        elif kind in (regex.MAX_REPEAT, regex.MIN_REPEAT, regex.POSSESSIVE_REPEAT):
            least, most, inner = value
            inner = _part(inner)
            if (least, most) == (0, 1) and inner.exact is not None:
                one = Part.of(inner.exact | {""})
            else:  # once or more: it begins and ends like what is repeated
                one = inner.inexact() if least else ANYTHING
        else:
            one = ANYTHING
        out = out.then(one)
    return out


def trigram_query(rule: Rule) -> Query:
    """A Boolean query of trigrams that every match of the rule holds; True if there is no mandatory one.

    Letters of any case count as lower case.
    """
    return _part(regex.parse(rule.pattern)).inexact().query


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


#: Rows of a block of posting lists, about.
BLOCK_ROWS = 4096


def postings(texts: DataFrame, rules: tuple[Rule, ...], blocks: int) -> DataFrame:
    """The inverted index of texts (k1, k2, text) for the rules' trigrams: block, trigram, rows (keys, each once).

    Case is folded; other trigrams are left out, as no query asks for them. A block has the rows whose k1 falls in it,
    so a list is never longer than a block, however common its trigram.
    """
    grams = sorted(set().union(*[trigrams(trigram_query(r)) for r in rules]))
    has = F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams])
    low = texts.withColumn("_low", F.lower("text"))
    each = low.select(F.pmod("k1", F.lit(blocks)).alias("block"), F.struct("k1", "k2").alias("row"), F.explode(F.array_compact(has)).alias("trigram"))
    return each.groupBy("block", "trigram").agg(F.collect_set("row").alias("rows"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(k1, k2, kinds): the rows that satisfy each rule's query by its posting lists, with those rules' kinds."""
    by_block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("lists"))

    def rows(query: Query) -> Column:
        if isinstance(query, str):
            return F.coalesce(F.col("lists")[query], F.array().cast("array<struct<k1: bigint, k2: bigint>>"))
        parts = [rows(q) for q in sorted(query[1], key=str)]
        out = parts[0]
        for p in parts[1:]:
            out = F.array_intersect(out, p) if query[0] == "and" else F.array_union(out, p)
        return out

    asked = [(r.kind, q) for r in rules if (q := trigram_query(r)) is not True]
    found = by_block.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), rows(q).alias("rows")) for k, q in asked])).alias("of"))
    return found.select(F.col("of.kind").alias("kind"), F.explode("of.rows").alias("row")).groupBy("row.k1", "row.k2").agg(F.collect_set("kind").alias("kinds"))


#: Elements of an array that are summed one by one; an array is summed in pieces of so many.
PIECE = 256


def running(x: Column, largest: bool = False) -> Column:
    """The sum of what stands before each element of an array of ints (or the largest of it, 0 at least)."""

    def step(so_far: Column, value: Column) -> Column:
        return F.greatest(so_far, value) if largest else so_far + value

    def scanned(values: Column, value) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(values, start, lambda s, v: F.struct(step(s["at"], value(v)).alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before")))

    pieces = F.transform(F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(x) - 1) / PIECE).cast("int")), lambda i: scanned(F.slice(x, i * PIECE + 1, F.lit(PIECE)), lambda v: v))
    whole = F.transform(F.array(pieces), lambda p: F.zip_with(p, scanned(p, lambda v: v["at"])["before"], lambda a, b: F.transform(a["before"], lambda v: step(v, b))))[0]
    return F.when(F.size(x) > 0, F.flatten(whole)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> of the leftmost non-overlapping matches that are long enough.

    Offsets are code points. split() gives what stands between the same matches that
    regexp_extract_all() gives, so running lengths of both are the offsets.
    """
    pattern = F.lit(rule.pattern)
    group, least = rule.kept
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)

    def spans(lengths: Column) -> Column:
        gap, n = lengths["gap"], lengths["n"]
        before = running(F.zip_with(gap, n, lambda a, b: a + b))
        return F.zip_with(F.zip_with(before, gap, lambda a, b: a + b), n, lambda a, b: F.struct(a.alias("start"), (a + b).alias("end"), F.lit(rule.kind).alias("kind")))

    lengths = F.transform(F.array(F.struct(gaps.alias("gap"), whole.alias("n"))), lambda x: F.struct(F.slice(x["gap"], 1, F.size(x["n"])).alias("gap"), x["n"].alias("n")))
    found = F.transform(lengths, spans)[0]
    if not group:
        return found if least <= 1 else F.filter(found, lambda x: x["end"] - x["start"] >= least)
    kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), F.length)
    return F.transform(F.filter(F.arrays_zip(found.alias("m"), kept.alias("k")), lambda x: x["k"] >= least), lambda x: x["m"])


def _scanned(rule: Rule) -> Rule:
    """For a rule of one class only: dropping short matches is asking for long ones at once."""
    if rule.pattern == "[0-9a-f]+":
        return Rule(rule.kind, f"[0-9a-f]{{{rule.kept[1]},}}")
    return rule


NONE = "CAST(array() AS array<struct<start: int, end: int, kind: string>>)"


def scan(documents: DataFrame, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """Every row of documents with `found`, an array of its matches (start, end, kind) by start, then rule order.

    documents has doc_id and text; other columns stay as they are, but for one called found, which is replaced. A
    null text counts as empty. Rows with one doc_id and text have the same matches; they stay as many as they were.
    """
    rules = BASE + added
    keyed = row_key(documents)
    texts = keyed.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = max(1, documents.count() // BLOCK_ROWS)
    found = candidates(postings(texts, rules, blocks), rules).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("kinds").alias("_scan_kinds"))
    joined = keyed.join(found, ["_k1", "_k2"], "left")
    text = F.coalesce("text", F.lit(""))
    each = []
    for rule in rules:
        asked = F.array_contains("_scan_kinds", rule.kind) if trigram_query(rule) is not True else F.regexp_like(text, F.lit(_scanned(rule).pattern))
        each.append(F.when(asked, matches(text, _scanned(rule))).otherwise(F.expr(NONE)))
    rank_of = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    out = joined.withColumn("_scan_found", F.concat(*each))
    ordered = F.transform(
        F.array_sort(F.transform("_scan_found", lambda x: F.struct(x["start"].alias("start"), rank_of[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")),
    )
    return out.select(*[F.col(c) for c in documents.columns if c != "found"], F.when(F.size("_scan_found") > 1, ordered).otherwise(F.col("_scan_found")).alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end of matches, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans per row of documents."""
    base = F.filter("found", lambda x: x["kind"].isin(*[r.kind for r in BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE]
    return scan(documents.select("doc_id", "text")).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def key_length(tail: Column) -> Column:
    """How many characters after its first line belong to a private key; tail is what stands between that line and the next such line.

    Header lines may come first, then lines of base64, of which the last may be short, then the END line; blank ones count as
    none, and a line may hold several words of base64. A key without END line ends with its base64. Where there is no base64 nothing belongs to
    a key, whatever follows. Each line is looked at once, so any number of lines will do.
    """
    base64 = "[A-Za-z0-9+/=]"

    def line(piece: Column) -> Column:
        # trailing line ends by length, as written-out ones are several characters
        bare = F.regexp_replace(F.regexp_replace(piece, r"(?:\r?\n|(?:\\r)?\\n)$", ""), r"\s++$", "")
        body = F.regexp_replace(bare, r"^\s++", "")
        inner = F.regexp_replace(F.regexp_replace(body, f"{KEY_END}[\\s\\S]*+$", ""), r"\s++$", "")
        only = inner.rlike(r"^[A-Za-z0-9+/=\s]++$")
        early = inner.rlike(f"(?<![^\\s]){base64}{{1,{SHORT - 1}}}+\\s")
        long = inner.rlike(f"{base64}{{{SHORT}}}")
        kind = (
            F.when(body == "", "blank")
            .when(F.length(inner) < F.length(body), F.when((inner == "") | (only & ~early), "end").otherwise("other"))
            .when(only & ~early & inner.rlike(f"{base64}{{{SHORT}}}$"), "full")
            .when(only & ~early, "short")
            .when(body.rlike(r"^[A-Za-z][A-Za-z-]*+:\x20"), "header")
            .otherwise("other")
        )
        upto = F.when(kind == "end", F.length(bare) - F.length(F.regexp_replace(body, f"^[\\s\\S]*?{KEY_END}", ""))).otherwise(F.length(bare))
        return F.struct(F.length(piece).alias("all"), upto.alias("upto"), kind.alias("kind"), (long & only & ~early).alias("long"))

    def whole(lines: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit("head").alias("state"))

        def step(seen: Column, x: Column) -> Column:
            """state: head (no base64 yet), body, last (after a short line), done."""
            state, kind, here = seen["state"], x["kind"], seen["at"] + x["upto"]
            begun = state.isin("body", "last")
            reached = (kind == "end") & (begun | (x["long"] & (state == "head")))
            text = (kind == "full") & state.isin("head", "body") | (kind == "short") & ((state == "body") | x["long"] & (state == "head"))
            then = (
                F.when(kind == "blank", state)
                .when((kind == "header") & (state == "head"), state)
                .when(text, F.when(kind == "full", F.lit("body")).otherwise(F.lit("last")))
                .otherwise(F.lit("done"))
            )
            end = F.when(state == "done", seen["end"]).when(reached | text, here).otherwise(seen["end"])
            return F.struct((seen["at"] + x["all"]).alias("at"), end.alias("end"), F.when(state == "done", state).otherwise(then).alias("state"))

        return F.aggregate(lines, start, step, lambda seen: seen["end"])

    return whole(F.transform(F.split(tail, ENDS, -1), line))


def with_whole_keys(found: Column, text: Column) -> Column:
    """found with its private keys to their ends. The text is cut at the keys' first lines, so each character is read once."""
    begin = next(r for r in ADDED if r.kind == "private_key").pattern
    keys, others = F.filter(found, lambda m: m["kind"] == "private_key"), F.filter(found, lambda m: m["kind"] != "private_key")
    tails = F.slice(F.split(text, begin, -1), F.lit(2), F.size(keys))
    longer = F.zip_with(keys, F.transform(tails, key_length), lambda m, n: F.struct(m["start"].alias("start"), (m["end"] + n).cast("int").alias("end"), m["kind"].alias("kind")))
    return F.when(F.size(keys) > 0, F.array_sort(F.concat(others, longer))).otherwise(found)


#: Characters of the pieces that a text is cut in, so that a place in it is found without walking up to it.
CUT = 1024


def redact(documents: DataFrame) -> DataFrame:
    """The same rows and columns with each run of matched characters in text replaced by [SECRET]; a null
    text stays null. Overlapping matches are replaced together; a private key is replaced to its end (key_length)."""
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    done = running(F.transform("found", lambda x: x["end"]), largest=True)  # what is replaced before each match

    def between(cut: Column, begin: Column, end: Column) -> Column:
        """Characters begin to end of the text cut in pieces."""

        def part(i: Column) -> Column:
            low, high = F.greatest(begin - i * CUT, F.lit(0)), F.least(end - i * CUT, F.lit(CUT))
            return F.get(cut, i).substr(low + 1, high - low)

        return F.when(begin < end, F.array_join(F.transform(F.sequence(F.floor(begin / CUT).cast("int"), F.floor((end - 1) / CUT).cast("int")), part), "")).otherwise(F.lit(""))

    def replaced(x: Column) -> Column:
        kept = F.zip_with("found", x["done"], lambda m, d: F.when(m["start"] >= d, F.concat(between(x["cut"], d, m["start"]), F.lit("[SECRET]"))).otherwise(F.lit("")))
        last = F.array_max(F.transform("found", lambda m: m["end"]))
        return F.concat(F.array_join(kept, ""), between(x["cut"], last, F.length("text")))

    text = F.when(F.size("found") > 0, F.transform(F.array(F.struct(pieces.alias("cut"), done.alias("done"))), replaced)[0]).otherwise(F.col("text"))
    named = {c: f"_scan_in_{c}" if c == "found" else c for c in documents.columns}
    out = scan(documents.withColumnsRenamed(named)).withColumn("found", with_whole_keys(F.col("found"), F.col("text")))
    return out.select(*[(text if c == "text" else F.col(new)).alias(c) for c, new in named.items()])
