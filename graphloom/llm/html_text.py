"""HTML main text (operator 9): consensus host paths.

Pass one scores each page's containers (text outside links, menus and the like, credited to the container around each
block) and votes, per host and generalised tag-class path, with each container's share of its page's score. Votes
are summed per (host, path) with partial aggregation, so a host with a third of all pages sends few rows; each host
keeps the path with most votes. Pass two re-extracts every page from the containers on its host's path, or from its own
best container where the page lacks that path.

Menus, footers, asides, forms and the like go by their element or role, other blocks by a whole class or id token: a listed
word, or listed words joined with others that only say what kind of box it is (``comments-list``), or a token that ends in a word for
readers' comments (``user-comments``). A token that merely holds such a word (``related-work``) says nothing. Inside an article names speak of
generic boxes only (``div``, lists, tables): its sections, headings and paragraphs are its text whatever they are called, but for sections of comments.
An ``article`` or ``main`` counts four times what other containers do, so that a longer block beside it doesn't take its place. A page of which
names leave nothing (a forum, say) is read without regard to them. A page is read in linear time, however broken: an unclosed script, style,
title or textarea takes the rest, as in browsers; any other unclosed element that holds no text ends at the next block.

Defined results: null and empty pages, and pages without text, give an empty string; pages without a readable host
form a host of their own; repeated rows give a row each; an empty table gives an empty result; columns other than
page_id, url and html are ignored. Blocks and line breaks separate words, inline elements don't; white space is as str.split sees it.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, materialize, small_slices, tidied

#: Hosts whose winning paths may be broadcast: at most this many short rows.
BROADCAST_HOSTS = 20_000
#: What the text of an article or main element counts.
WHOLE = 4.0
#: A path longer than this goes on from its hash.
MAX_PATH = 400

# Element names and the words in class and id that mark what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style title textarea".split())
NO_TEXT = frozenset("noscript template svg math iframe object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
JUNK = frozenset("nav footer aside form button head menu dialog".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search".split())
CONTAINER = frozenset("article main section div td body blockquote".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
JUNK_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promos related replies share sharing sidebar signup skip social sponsor sponsored sponsors subscribe toolbar widget widgets".split())
BOX_WORDS = frozenset("area bar block box btn button buttons consent container content div form global group holder inner item items left link links list main outer page panel post posts right row section site slot thread top bottom unit wrap wrapper".split())
COMMENT_WORDS = frozenset("comment comments commentlist commentary commenters disqus replies".split())
#: Also an article's own words; they mean comments outside an article and on generic boxes.
REPLY_WORDS = frozenset("discussion discussions respond responses reviews".split())
GENERIC = frozenset("div ul ol dl table td tr li".split())
COMMENT_BOXES = GENERIC | {"section", "article"}

ATTRIBUTES = r"""((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>"""
TOKEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/<>]*+)(?:" + ATTRIBUTES + ")?)")
QUOTE = re.compile("[>\"']")
CLOSES = {tag: re.compile(f"<(/{'' if tag in RAW_TEXT else '?'}){tag}(?![a-zA-Z0-9-])", re.I) for tag in RAW_TEXT | NO_TEXT}
BLOCK = re.compile(r"</?(?:" + "|".join(sorted(CLOSES_P | CONTAINER)) + r")(?![a-zA-Z0-9-])", re.I)
MARK = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
DIGITS = re.compile(r"\d+")
HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


def host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), HOST, 1))


def is_junk(token: str) -> bool:
    parts = [p for p in token.replace("_", "-").split("-") if p]
    return any(p in JUNK_WORDS for p in parts) and all(p in JUNK_WORDS or p in BOX_WORDS or p.isdigit() for p in parts)


def is_comments(token: str, replies: bool) -> bool:
    """Whether a token ends in a word for readers' comments; ``replies``: also in one that an article may use itself."""
    parts = [p for p in token.replace("_", "-").split("-") if p and not p.isdigit()]
    return bool(parts) and (parts[-1] in COMMENT_WORDS or replies and parts[-1] in REPLY_WORDS)


def is_aside(tag: str, tokens: list[str], inside: bool) -> bool:
    """Whether an element's class and id tokens say that it isn't the article's text."""
    if tag in ("html", "body", "main") or tag == "article" and not inside and not any(is_comments(x, False) for x in tokens):
        return False
    if tag in COMMENT_BOXES and any(is_comments(x, not inside or tag in GENERIC) for x in tokens):
        return True
    return (not inside or tag in GENERIC) and any(is_junk(x) for x in tokens)


class Ends:
    """Where the tags of a page end, in time linear in the page altogether."""

    def __init__(self, page: str):
        self.page, self.dead, self.last = page, set(), page.rfind(">")
        self.pairs: dict[str, dict[int, int]] = {}

    def first(self, at: int) -> int:
        """After the next closing bracket, or -1."""
        return self.page.find(">", at) + 1 if at <= self.last else -1

    def tag(self, at: int) -> int:
        """After the bracket that closes a tag whose attributes begin at ``at``: one outside quotes, or else the first; -1 if there is none.

        An opening quote from which no such bracket was found is dead, and no scan passes it again.
        """
        if at > self.last:
            return -1
        page, seen, here = self.page, [], at
        while m := QUOTE.search(page, here):
            if m[0] == ">":
                return m.end()
            if m.start() in self.dead:
                break
            seen.append(m.start())
            here = page.find(m[0], m.end()) + 1
            if not here:
                break
        self.dead.update(seen)
        return self.first(at)

    def closed(self, tag: str, start: int, at: int) -> int:
        """After the closing tag of the element whose tag is [start, at). Without one: the page's end if it holds raw text, or else the next block."""
        if tag in RAW_TEXT:
            m = CLOSES[tag].search(self.page, at) if tag not in self.pairs else None
            end = self.first(m.end()) if m else -1
            if end < 0:
                self.pairs[tag] = {}
            return end if end > 0 else len(self.page) + 1
        if tag not in self.pairs:
            self.pairs[tag] = self.matched(tag)
        if start in self.pairs[tag]:
            return self.pairs[tag][start]
        m = BLOCK.search(self.page, at)
        return m.start() if m else len(self.page) + 1

    def matched(self, tag: str) -> dict[int, int]:
        """Starts of an element's opening tags, with the ends of the closing ones that belong to them."""
        stack, out = [], {}
        for m in CLOSES[tag].finditer(self.page):
            end = self.first(m.end())
            if end < 0:
                break
            if not m[1]:
                if self.page[end - 2] != "/":
                    stack.append(m.start())
            elif stack:
                out[stack.pop()] = end
        return out


class Box:
    """A container: its path, score, and the pieces of text in it, in page order."""

    __slots__ = ("path", "score", "first", "last", "up", "inside", "whole")

    def __init__(self, path: str, up: Box | None, first: int, inside: bool):
        self.path, self.up, self.score, self.first, self.last, self.inside, self.whole = path, up, 0.0, first, -1, inside, False


def credit(boxes: list[Box]) -> None:
    """Pass scores up: all of it inside an article; outside, a quarter of a box's own, or all where it is one of several alike."""
    alike = Counter((id(b.up), b.path) for b in boxes if b.up is not None)
    own = [b.score for b in boxes]
    for b, value in zip(reversed(boxes), reversed(own), strict=True):
        if b.up is not None:
            b.up.score += b.score if b.inside else value if alike[id(b.up), b.path] > 1 else value / 4
    for b in boxes:
        if b.whole:
            b.score *= WHOLE


def parse(page: str, names_count: bool = True) -> tuple[list[Box], list[str]]:
    """(containers in order, pieces of text): a container's text is pieces[first:last]. Without names_count class and id mark nothing."""
    pieces: list[str] = []
    boxes: list[Box] = []
    stack: list[tuple[str, str, bool, bool, Box | None]] = [("", "", False, False, None)]  # tag, path, inside an article, junk, container
    open_ = Counter()
    links, at, size = 0, 0, len(page)
    ends = Ends(page)
    pending = 0  # where the text before the next token begins

    def text(end: int) -> None:
        if end > pending and not stack[-1][3]:
            own = entities.unescape(page[pending:end])
            pieces.append(own)
            box = stack[-1][4]
            if box is not None and not links:
                n = len(own.strip())
                value = n + 10.0 * own.count(",") if n > 20 else 0.3 * n
                box.score += value

    while at <= size:
        m = TOKEN.search(page, at)
        if not m:
            text(size)
            break
        tag = (m[2] or "").lower()
        if not tag:
            if m[0] == "<!--":
                stop = page.find("-->", m.end())
                end = stop + 3 if stop >= 0 else size
            else:
                end = ends.first(m.end())
        else:
            end = m.end() if m[3] is not None else ends.tag(m.end())
        if end < 0:  # no bracket closes it: it is text
            at = m.end()
            continue
        text(m.start())
        at = pending = end
        if not tag:
            continue
        closing, attributes = m[1], m[3] if m[3] is not None else page[m.end() : end - 1]
        if tag in CLOSES:
            if not closing and not attributes.endswith("/"):
                at = pending = ends.closed(tag, m.start(), at)
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if not stack[-1][3]:
            pieces.append(" ")
        if tag in VOID:
            continue
        if closing:
            if open_[tag]:
                links, k = 0, len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                for entry in stack[k:]:
                    open_[entry[0]] -= 1
                    if entry[4] is not None and entry[4].last < 0 and entry[4] is not stack[k - 1][4]:
                        entry[4].last = len(pieces)
                del stack[k:]
                if not stack[-1][3]:
                    pieces.append(" ")
            continue
        if attributes.endswith("/") and tag not in CONTAINER and tag != "p":
            continue
        if tag in CLOSES_P and stack[-1][0] == "p" or tag in ("li", "tr", "td", "th", "dt", "dd", "option") and stack[-1][0] == tag:
            open_[stack.pop()[0]] -= 1
        _, path, inside, junk, box = stack[-1]
        marks = {k.lower(): (a or b or c).lower() for k, a, b, c in MARK.findall(attributes)} if "=" in attributes else {}
        names = marks.get("class", "").split()
        junk = junk or tag in JUNK or (tag == "header" and not inside) or marks.get("role") in JUNK_ROLES or (names_count and is_aside(tag, [*names, *marks.get("id", "").split()], inside))
        style = DIGITS.sub("", " ".join(sorted(names)[:2]))
        here = f"{path}>{tag}" + (f".{style}" if style else "")
        if len(here) > MAX_PATH:
            here = "#" + hashlib.md5(here.encode("utf-8", "replace")).hexdigest()
        if tag in CONTAINER and not junk:
            box = Box(here, box, len(pieces), inside)
            box.whole = tag in ("article", "main")
            boxes.append(box)
        open_[tag] += 1
        stack.append((tag, here, inside or tag in ("article", "main"), junk, box))
    for box in boxes:
        if box.last < 0:
            box.last = len(pieces)
    credit(boxes)
    return boxes, pieces


def read(page: str) -> tuple[list[Box], list[str]]:
    """parse() by names, or without them where they leave no text."""
    boxes, pieces = parse(page)
    return (boxes, pieces) if any(p.strip() for p in pieces) else parse(page, False)


def best_paths(boxes: list[Box]) -> list[tuple[str, float]]:
    """A page's paths, best first, each with its share of the page's score."""
    total: dict[str, float] = {}
    for b in boxes:
        total[b.path] = total.get(b.path, 0.0) + b.score
    whole = sum(total.values())
    return [(p, s / whole) for p, s in sorted(total.items(), key=lambda x: (-x[1], x[0])) if s > 0]


def extract(page: str, path: str | None) -> str:
    """The text of the containers on the path, or of the page's best one."""
    boxes, pieces = read(page)
    if path is None or not any(b.path == path and b.score > 0 for b in boxes):
        own = best_paths(boxes)
        path = own[0][0] if own else None
    if path is None:
        return " ".join("".join(pieces).split())
    out, at = [], 0
    for b in boxes:
        if b.path == path and b.first >= at:
            out.append("".join(pieces[b.first : b.last]))
            at = b.last
    return " ".join(" ".join(out).split())


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes), summed over all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = {}
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, share in best_paths(read(page or "")[0]):
                    sums[name, path] = sums.get((name, path), 0.0) + share
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in sums], pa.string()), pa.array([p for _, p in sums], pa.string()), pa.array(list(sums.values()), pa.float64())], names=["host", "path", "votes"])

    return pages.select(host().alias("host"), "html").mapInArrow(tidied(run), "host string, path string, votes double").groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))


def winners(counted: DataFrame) -> DataFrame:
    """(host, path): the path with most votes, ties to the smaller path."""
    w = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    return counted.withColumn("k", F.row_number().over(w)).where("k = 1").select("host", "path")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, a row for each row of pages."""
    bounded_batches(pages.sparkSession)
    paths = materialize(winners(votes(pages)))
    rows = pages.select("page_id", "url", "html", host().alias("host"))
    few = paths.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    dealt = rows.join(F.broadcast(paths) if few else paths, "host", "left").select("page_id", "url", "html", "path")  # at most BROADCAST_HOSTS short rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, 2, 512):
                text = [extract(h or "", p) for h, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return dealt.mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")
