"""Main text of web pages: blocks that recur on a site are its template and go, the article's blocks stay.

Every block element's subtree is hashed with its place: its bytes, from start tag to end, and the tags it stands in.  Spark counts on how many
different pages of a host each such subtree recurs; what is on ``MIN_PAGES`` of them or more, and on a share of ``SHARE`` of all, is
deleted, inside and outside of articles.  The share keeps phrases that merely are common on a large host; a block that is
nothing but links needs none, as menus differ from part to part of a site.  Inline elements never go alone, so a kept block keeps all its words, and a heading goes only with a block that holds it.
Pages that copy one another count once for each different main part, so copies don't make their own text a template.

What can't recur is told by its tag, role or attributes: scripts, styles, navigation, headers and footers of the page, asides, hidden parts,
media, and forms that don't hold the text.  A class decides only ties, for comments, notices and the like, which differ from page to page:
a container outside of tables, with no article in it and less text than stands around it, goes if a part of one of its classes is in
a short list; so does an article that is a comment.

Cases with a defined result: a null page is empty, and an empty one has an empty text; text outside any block is a block;
unclosed and misnested elements end where their parent ends; a tag with a quote that never ends, and all tags after it, end at their first ``>``;
on fewer than ``MIN_PAGES`` different pages of a host nothing is a template; a null url is a host of its own; rows with repeated or null ids keep their
own results; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import small_batches, written

#: A template subtree is on at least so many different pages of its host.
MIN_PAGES = 3
#: And on such a share of them, but for what is nothing but links.
SHARE = 0.3
#: A block of an article's prose (a paragraph, a list's item) needs more to be a template: so many pages, and such a share.
PROSE_PAGES, PROSE_SHARE = 10, 0.5
#: Template subtrees of all hosts, of sixteen bytes each, up to which their table is broadcast.
BROADCAST_TREES = 1_000_000

# Fixed values of HTML.
_VOID = {b"area", b"base", b"br", b"col", b"embed", b"hr", b"img", b"input", b"link", b"meta", b"param", b"source", b"track", b"wbr"}
_RAW = {b"script", b"style", b"title", b"textarea", b"iframe", b"xmp", b"noembed", b"noframes"}
_BLOCK = set(
    b"address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    b"header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_PROSE = {b"p", b"h1", b"h2", b"h3", b"h4", b"h5", b"h6", b"blockquote", b"pre", b"li", b"dd", b"dt", b"td", b"th", b"tr", b"tbody", b"thead", b"caption", b"figcaption"}
_FURNITURE = set(
    b"head nav footer aside script style noscript template iframe svg math canvas object audio video map button select textarea dialog menu "
    b"noembed noframes xmp title datalist".split()
)
_ENDS_P = _BLOCK - {b"html", b"body", b"td", b"th", b"tr", b"tbody", b"thead", b"tfoot", b"caption", b"option", b"legend"}
_SIBLING = {b"li": {b"ul", b"ol", b"menu", b"dir"}, b"dd": {b"dl"}, b"dt": {b"dl"}, b"td": {b"tr", b"table"}, b"th": {b"tr", b"table"}, b"tr": {b"table", b"tbody", b"thead", b"tfoot"}, b"option": {b"select", b"datalist"}}
_SAME = {b"dd": {b"dd", b"dt"}, b"dt": {b"dd", b"dt"}, b"td": {b"td", b"th"}, b"th": {b"td", b"th"}}

_OPEN = re.compile(rb"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?])")
#: The rest of a tag; what is matched is never tried again.
_REST = re.compile(rb"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: An attribute: its name, and its value in quotes or without.
_ATTRIBUTE = re.compile(rb"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ROLES = set(b"navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NO_DISPLAY = re.compile(rb"display\s*:\s*none", re.I)
_HINTS = set(b"ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disqus menu modal nav navbar newsletter notice pagination popup promo share sharing sidebar social sponsor sponsored subscribe widget".split())
_HINTED = {b"div", b"section", b"ul", b"ol", b"dl", b"span", b"a"}


def _attributes(raw: bytes) -> dict[bytes, bytes]:
    """Names in lower case and values; of repeated names the first counts."""
    out: dict[bytes, bytes] = {}
    for name, double, single, plain in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), double or single or plain)
    return out


class _Page:
    """Elements of a page in the order of their start tags, and its runs of text."""

    def __init__(self, raw: bytes) -> None:
        self.tag: list[bytes] = []
        self.attrs: list[bytes] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.parent: list[int] = []
        self.text: list[tuple[int, int, int]] = []  # start, end, element (-1: none)
        self.breaks: list[tuple[int, int]] = []  # where a block begins or ends; as text runs of no length
        stack: list[int] = []
        self.open: Counter[bytes] = Counter()  # of each tag, how many are in the stack
        at = look = 0
        quotes = True
        while (lt := raw.find(b"<", look)) >= 0:
            m = _OPEN.match(raw, lt)
            if not m:
                look = lt + 1
                continue
            rest = _REST.match(raw, m.end()) if m[3] and quotes else None
            if m[3] and not rest:
                quotes = False
            stop = raw.find(b"-->", m.end()) + 3 if m[1] else rest.end() if rest else raw.find(b">", m.end()) + 1
            if stop < 3:
                if not m[1]:
                    break  # no tag ends any more
                stop = len(raw)
            if lt > at:
                self.text.append((at, lt, stack[-1] if stack else -1))
            at = look = stop
            if not m[3]:
                continue
            name, attrs = m[3].lower(), raw[m.end() : stop - 1]
            if m[2]:
                if self.open[name]:
                    k = len(stack) - 1
                    while self.tag[stack[k]] != name:
                        k -= 1
                    mine = stack[k]
                    self._pop(stack, k, lt)
                    self.end[mine] = at
                continue
            self._close_implied(stack, name, lt)
            me = len(self.tag)
            self.tag.append(name)
            self.attrs.append(attrs)
            self.start.append(lt)
            self.end.append(at)
            self.parent.append(stack[-1] if stack else -1)
            if name in _VOID or attrs.endswith(b"/"):
                self.text.append((lt, lt, me))
            elif name in _RAW:
                stop = re.compile(rb"</" + re.escape(name) + rb"[\s/>]", re.I).search(raw, at)
                inner = stop.start() if stop else len(raw)
                self.text.append((at, inner, me))
                at = raw.find(b">", inner) + 1 if stop else len(raw)
                at = look = at or len(raw)
                self.end[me] = at
            else:
                stack.append(me)
                self.open[name] += 1
                if name in _BLOCK:
                    self.text.append((lt, lt, me))
        if at < len(raw):
            self.text.append((at, len(raw), stack[-1] if stack else -1))
        for x in stack:
            self.end[x] = len(raw)

    def _pop(self, stack: list[int], k: int, at: int) -> None:
        """Ends the elements of the stack from k on."""
        for x in stack[k:]:
            self.end[x] = at
            self.open[self.tag[x]] -= 1
        del stack[k:]

    def _close_implied(self, stack: list[int], name: bytes, at: int) -> None:
        """Ends what the new element can't stand in: a paragraph before a block, a list item before the next."""
        if name in _SIBLING:
            same = _SAME.get(name, {name})
            if any(self.open[t] for t in same):
                for k in range(len(stack) - 1, -1, -1):
                    t = self.tag[stack[k]]
                    if t in same:
                        self._pop(stack, k, at)
                    if t in same or t in _SIBLING[name] or t in (b"body", b"html"):
                        break
        if name in _ENDS_P and self.open[b"p"]:
            for k in range(len(stack) - 1, -1, -1):
                t = self.tag[stack[k]]
                if t == b"p":
                    self._pop(stack, k, at)
                if t in _BLOCK:
                    break

    def furniture(self) -> list[bool]:
        """Of each element whether it, or one that it is in, can't be content by its tag or role, or by its class where that decides."""
        out: list[bool] = []
        in_article: list[bool] = []
        holds = [False] * len(self.tag)  # an article or main element
        for k in range(len(self.tag) - 1, -1, -1):
            if (holds[k] or self.tag[k] in (b"article", b"main")) and self.parent[k] >= 0:
                holds[self.parent[k]] = True
        runs = [a for a, _, k in self.text if k < 0 or self.tag[k] not in _RAW]
        upto = [0, *accumulate(b - a for a, b, k in self.text if k < 0 or self.tag[k] not in _RAW)]
        def smaller(k: int) -> bool:
            """Whether there is more text outside of an element than in it."""
            own = upto[bisect_left(runs, self.end[k])] - upto[bisect_left(runs, self.start[k])]
            return 2 * own < upto[-1]

        for k, (tag, attrs, parent) in enumerate(zip(self.tag, self.attrs, self.parent, strict=True)):
            inside = parent >= 0 and in_article[parent]
            bad = parent >= 0 and out[parent]
            if not bad:
                bad = tag in _FURNITURE or (tag == b"header" and not inside) or (tag in (b"form", b"fieldset") and not holds[k] and smaller(k))
                if not bad and len(attrs) > 5 and not holds[k] and tag not in (b"html", b"body", b"main"):
                    a = _attributes(attrs)
                    hidden = b"hidden" in a or a.get(b"aria-hidden", b"").lower() == b"true" or _NO_DISPLAY.search(a.get(b"style", b""))
                    bad = tag != b"article" and bool(hidden or not _ROLES.isdisjoint(a.get(b"role", b"").lower().split()))
                    if not bad and (tag in _HINTED or tag == b"article") and b"class" in a:
                        words = set(a[b"class"].lower().replace(b"_", b"-").replace(b"-", b" ").split())
                        bad = not words.isdisjoint((b"comment", b"comments") if tag == b"article" else _HINTS) and smaller(k)
            out.append(bad)
            in_article.append(inside or (tag in (b"article", b"main") and not bad))
        return out

    def main(self, bad: list[bool]) -> list[bool]:
        """Of each element whether it is in the main part: the articles, else the main element, else everything."""
        for wanted in ((b"article",), (b"main",)):
            top = [t in wanted and not b for t, b in zip(self.tag, bad, strict=True)]
            if any(top):
                inside: list[bool] = []
                for own, parent in zip(top, self.parent, strict=True):
                    inside.append(own or (parent >= 0 and inside[parent]))
                return inside
        return [True] * len(self.tag)

    def candidates(self, raw: bytes, inside: list[bool]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Block elements that go if they recur, but for the page's own frame and headings; a hash of the tags each stands in; their kinds.

        Kinds: 0 nothing but links, 1 others, 2 an article's prose.
        """
        keep = (b"html", b"head", b"body", b"article", b"main", b"h1", b"h2", b"h3", b"h4", b"h5", b"h6", b"hr")
        which = [k for k, t in enumerate(self.tag) if t in _BLOCK and t not in keep]
        places: list[int] = []
        linked: list[bool] = []
        for t, parent in zip(self.tag, self.parent, strict=True):
            places.append(crc32(t, places[parent] if parent >= 0 else 0))
            linked.append(t == b"a" or (parent >= 0 and linked[parent]))
        said = [(a, 0 if k >= 0 and linked[k] else 1) for a, b, k in self.text if b > a and not raw[a:b].isspace()]
        at = [a for a, _ in said]
        plain = [0, *accumulate(x for _, x in said)]
        kinds = []
        for k in which:
            lo, hi = bisect_left(at, self.start[k]), bisect_left(at, self.end[k])
            kinds.append(0 if hi > lo and plain[hi] == plain[lo] else 2 if inside[k] and self.tag[k] in _PROSE else 1)
        return which, np.array([places[k] for k in which], np.uint64), np.array(kinds, np.uint64)

    def blocks(self, raw: bytes, gone: list[bool], inside: list[bool], whole: bool) -> list[str]:
        out: list[str] = []
        parts: list[bytes] = []
        block = -2
        owner: dict[int, int] = {-1: -1}
        dead: list[bool] = []
        for k, parent in enumerate(self.parent):
            dead.append(gone[k] or (parent >= 0 and dead[parent]))
            owner[k] = k if self.tag[k] in _BLOCK else owner[parent]

        def close() -> None:
            if parts:
                joined = b"".join(parts).decode(errors="replace")
                joined = " ".join((html.unescape(joined) if "&" in joined else joined).split())
                if joined:
                    out.append(joined)
                parts.clear()

        for a, b, k in self.text:
            mine = owner[k]
            if mine != block or (a == b and k >= 0 and self.tag[k] in _BLOCK):
                close()
                block = mine
            if k >= 0 and (dead[k] or not inside[k]) or (k < 0 and not whole):
                continue
            if a == b:
                if k >= 0 and self.tag[k] == b"br":
                    parts.append(b" ")
            else:
                parts.append(raw[a:b])
        close()
        return out


def _parsed(c: X.Chunk) -> Iterator[tuple[int, bytes, _Page, list[bool], list[bool]]]:
    for k in range(len(c)):
        raw = X.text_of(c, k)
        page = _Page(raw)
        bad = page.furniture()
        yield k, raw, page, bad, page.main(bad)


def _hashes(sums: np.ndarray, offset: int, page: _Page, which: list[int]) -> np.ndarray:
    a = np.array([page.start[k] for k in which], np.int64) + offset
    b = np.array([page.end[k] for k in which], np.int64) + offset
    return X.span_hash(sums, a, b)


def _placed(sums: np.ndarray, offset: int, page: _Page, which: list[int], places: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Hashes of subtrees at their places; the last two bits tell the kind."""
    h = X.mix(_hashes(sums, offset, page, which) + places * X.U(0x9E3779B97F4A7C15))
    return (h & ~X.U(3) | kinds).view(np.int64)


def _subtree_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page, main (hash of the page's main part) and subtree, once for each page."""
    for b in batches:
        hosts, pages = b.column(0).to_numpy(), b.column(1).to_numpy()
        for c in X.chunks(b.column(2)):
            sums = X.item_sums(c.buf.astype(X.U) + X.U(1))
            rows: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
            for k, raw, page, bad, inside in _parsed(c):
                off = int(c.offs[k])
                tops = [i for i in range(len(page.tag)) if inside[i] and not bad[i] and (page.parent[i] < 0 or not inside[page.parent[i]])]
                whole = _hashes(sums, off, page, [i for i in range(len(page.tag)) if page.tag[i] in (b"article", b"main", b"body") and i in tops] or tops)
                mine = int(X.mix(np.array([whole.sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0])
                which, places, kinds = page.candidates(raw, inside)
                found = np.unique(_placed(sums, off, page, which, places, kinds)) if which else np.zeros(1, np.int64)  # 0: a page without any
                rows.append((*(np.full(len(found), x, np.int64) for x in (hosts[c.lo + k], pages[c.lo + k], mine)), found))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["host", "page", "main", "tree"])


def _host(url: str):
    # scheme and address are taken off; no scheme: the first segment
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)", 1)))


def subtrees(pages: DataFrame) -> DataFrame:
    """host, page (hash of the HTML), main (hash of its main part) and tree (hash of a block's subtree at its place), as a table."""
    small_batches(pages.sparkSession, 1000)
    own = pages.select(_host("url").alias("host"), F.xxhash64("html").alias("page"), F.col("html").alias("html"))
    return written(own.mapInArrow(_subtree_mapper, "host long, page long, main long, tree long"), "subtrees")


def templates(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host and tree of the subtrees that are on so many different pages of it, and on such a share of them.  found: of ``subtrees``."""
    each = found.select("host", "main", "tree").distinct()
    pages = found.select("host", "main").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    often = each.where("tree <> 0").groupBy("host", "tree").agg(F.count(F.lit(1)).alias("on")).where(F.col("on") >= min_pages)
    kind = F.col("tree").bitwiseAND(3)
    prose = (F.col("on") >= max(min_pages, PROSE_PAGES)) & (F.col("on") >= PROSE_SHARE * F.col("pages"))
    enough = F.when(kind == 2, prose).when(kind == 1, F.col("on") >= SHARE * F.col("pages")).otherwise(True)
    return often.join(pages, "host").where(enough).select("host", "tree")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        trees = b.column(3)
        texts: list[str] = []
        for c in X.chunks(b.column(2)):
            sums = None
            for k, raw, page, bad, inside in _parsed(c):
                t = trees[c.lo + k].values
                if t is not None and len(t):
                    sums = X.item_sums(c.buf.astype(X.U) + X.U(1)) if sums is None else sums
                    which, places, kinds = page.candidates(raw, inside)
                    hit = np.isin(_placed(sums, int(c.offs[k]), page, which, places, kinds), t.to_numpy())
                    for i in np.flatnonzero(hit).tolist():
                        bad[which[i]] = True
                texts.append("\n".join(page.blocks(raw, bad, inside, all(inside))))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per row: page_id, url, text (blocks joined by line feeds) and n_chars (its code points)."""
    found = subtrees(pages)
    table = written(templates(found, min_pages), "templates")
    few = table.count() <= BROADCAST_TREES
    # of each page the template subtrees that it holds
    hits = found.select("host", "page", "tree").join(F.broadcast(table) if few else table, ["host", "tree"]).groupBy("host", "page").agg(F.collect_set("tree").alias("trees"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("html"), _host("url").alias("host"), F.xxhash64("html").alias("page"))
    joined = own.join(hits, ["host", "page"], "left").select("page_id", "url", "html", "trees")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
