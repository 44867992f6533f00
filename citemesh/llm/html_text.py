"""Main text of web pages by consensus host paths.

Each page is read into blocks that know their containers' generalised path: tag and class names from the
body down, digits as `#`. A container's score is the plain text of all paragraphs below it, links counting
against them; from the outermost one down, a page goes on to a child that holds nearly all of its parent's
text (an article or main element: most of it), so an article that is split over siblings keeps them all.
Where that ends the page votes for the container's path. Votes are summed per host in Spark; a host's
winning paths are those with at least a fifth of its votes. Then each page is read again and gives the text
under its host's winning path: its own vote if that won, else the most voted winner that holds at least
half as much text on the page as the page's own best container, else (or where a host has no winner) that
container.

A page is scanned once, by the states of HTML's tokeniser: a quote opens a value only right after `=`, so
stray quotes and apostrophes swallow nothing. Containers are nodes of a tree with links to their parents; time
is linear in the page's length, whatever its depth.

What is never text: navigation, menus, footers, asides, forms and their controls, dialogs, scripts, styles,
drawings, hidden elements, and elements whose role, or one of whose class or id names, says navigation,
footer, sidebar, notice, advert, form or reader comments and, besides, only where on the page it stands
(`user-comments`, `cookiebanner`): a name such as `comment-on-law` or `ad-hoc` says something else. Headers are text where they stand in an
article or main element, or in the container that was chosen, unless that holds the page's navigation or
footer too. Character references are decoded; white space in a block becomes one space; blocks are joined
in page order by one space.

Edge cases: a null or empty page, or one without text, gives an empty text; a page without a host votes
with all such pages; unclosed tags, comments and scripts end where the page ends; equal scores go to the
inner container, equal votes by path; repeated rows vote each; extra columns are not read; an empty table
gives no rows. A page of any length is read whole, in memory of its own size. Any share of pages may lie
on one host: votes are summed map-side and winners, five at most for a host, joined by checked broadcast
or salts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, join_hot, slices

WIN_SHARE = 0.2
#: Share of a container's text that a child must hold for the page to go on to it; for article and main; and
#: of what it began with, or of the last such element, that many steps may leave.
NEARLY_ALL, MOST, STILL = 0.95, 0.6, 0.8

RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe", "title")}
NAME = re.compile(r"[^\s/>]+")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
VALUE = re.compile(r"[^\s>]*")
#: Attributes that tell what an element is.
TELLING = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br math mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics".split())
SKIPPED = frozenset("nav footer aside form button dialog menu head input select datalist svg annotation".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Fixed words in class and id names that say what is no article text, ...
KINDS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer sidebar ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr notice notices notification notifications popup modal overlay paywall newsletter subscribe subscription signup login form forms comment comments commentlist disqus respond reply replies".split())
HEADERS = frozenset("header masthead banner".split())
#: ... and words that may stand beside them, as they only say where it is.
PLACES = frozenset("top bottom left right main site page box wrapper wrap container content list bar block section area inner outer primary secondary global post posts article articles entry item items link links button buttons icon icons group row col column unit slot zone widget region holder panel module component desktop mobile text info id js sub mini user users reader readers thread threads wide narrow small large big full half fixed sticky floating dynamic native".split())
ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog alert form menu menubar".split())
SPLIT = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CONTAINERS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td dd dt th div section article main figure figcaption ul ol dl table".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td dd dt th ul ol dl table tbody thead tfoot tr caption figure figcaption details summary address hgroup".split())


#: Words that are written together, such as `cookiebanner`.
TOGETHER = re.compile("(?:" + "|".join(sorted(KINDS | HEADERS | PLACES, key=len, reverse=True)) + ")+")
PARTS = re.compile("|".join(sorted(KINDS | HEADERS | PLACES, key=len, reverse=True)))


@lru_cache(maxsize=20_000)
def _named(name: str, kinds: frozenset) -> bool:
    """Whether a name says one of these kinds, and else only a place."""
    words = {w for w in SPLIT.split(CAMEL.sub("-", name).lower()) if w}
    for w in [w for w in words if w not in KINDS | HEADERS | PLACES and len(w) <= 30 and TOGETHER.fullmatch(w)]:
        words.remove(w)
        words.update(PARTS.findall(w))
    return not words.isdisjoint(kinds) and words <= KINDS | HEADERS | PLACES


def _unwanted(tag: str, attributes: dict[str, str]) -> tuple[bool, bool, str]:
    """Whether an element is no article text, whether it is a header, and its classes, generalised."""
    bad, header, classes = tag in SKIPPED, tag == "header", ""
    whole = tag in ("body", "html", "article", "main")  # its names tell of the page
    for name, value in attributes.items():
        if name == "class":
            classes = ".".join(sorted(set(DIGITS.sub("#", value).split())))
        if name in ("class", "id") and not whole:
            bad = bad or any(_named(n, KINDS) for n in value.split())
            header = header or any(_named(n, HEADERS) for n in value.split())
        elif name == "role":
            bad = bad or value.lower() in ROLES
            header = header or value.lower() == "banner"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            bad = True
    return bad, header, classes


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str] | str, bool]]:
    """(kind, tag, attributes or text, whether it closes itself) of a page: kind is `text`, `open`, `close` or `cut` (a
    comment, a script). One pass; what is unclosed ends with the page."""
    n, at = len(html), 0
    last = {q: html.rfind(q) for q in "\"'"}  # a quote there is never closed
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 >= n:
            yield "text", "", html[at:], False
            return
        c = html[lt + 1]
        close = c == "/"
        first = html[lt + 2 : lt + 3] if close else c
        if not (first.isascii() and first.isalpha()) and c not in "!?" and not close:
            yield "text", "", html[at : lt + 1], False  # no tag
            at = lt + 1
            continue
        if lt > at:
            yield "text", "", html[at:lt], False
        if not (first.isascii() and first.isalpha()):
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif html.startswith("<![CDATA[", lt):
                end = html.find("]]>", lt + 9)
                yield "text", "", html[lt + 9 : n if end < 0 else end].replace("&", "&amp;"), False
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            yield "cut", "", "", False
            continue
        m = NAME.match(html, lt + 1 + close)
        tag, at, found, slash = m[0].lower(), m.end(), {}, False
        while at < n and html[at] != ">":
            m = ATTRIBUTE.match(html, at)
            if not m:  # spaces and slashes before the end
                at = html.find(">", at)
                at = n if at < 0 else at
                break
            name, at, value = m[1].lower(), m.end(), ""
            if m[2] and at < n:
                q = html[at]
                if q in last and at < last[q]:
                    end = html.find(q, at + 1)
                    value, at = html[at + 1 : end], end + 1
                else:
                    v = VALUE.match(html, at)
                    value, at = v[0], v.end()
            if name in TELLING:
                found.setdefault(name, unescape(value))
        slash = at < n and html[at - 1] == "/"
        at += 1
        if not close and tag in RAW:
            m = RAW[tag].search(html, at)
            at = m.end() if m else n
            yield "cut", "", "", False
            continue
        yield "close" if close else "open", tag, found, slash


class Page:
    """A page's blocks, in page order, and its containers: nodes that follow their parents. Node 0 stands above
    the page. A block is (node, text, share of link text, depth of the outermost header that is not in an
    article or main element)."""

    def __init__(self, html: str):
        self.parent, self.name, self.depth = [0], [""], [0]
        self.child: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, float, int]] = []
        self.frames: set[int] = set()  # with navigation or a footer of their own
        self._scan(html)

    def node(self, up: int, name: str) -> int:
        at = self.child.get((up, name))
        if at is None:
            at = self.child[up, name] = len(self.name)
            self.parent.append(up)
            self.name.append(name)
            self.depth.append(self.depth[up] + 1)
        return at

    def _scan(self, html: str) -> None:
        # tag, whether a block, and with it: node, elements that are no text, article elements, header's depth
        stack: list[tuple[str, bool, int, int, int, int]] = []
        opened: dict[str, int] = {}
        text: list[str] = []
        linked = 0

        def top() -> tuple[int, int, int, int]:
            return stack[-1][2:] if stack else (0, 0, 0, 0)

        def flush() -> None:
            nonlocal linked
            if text:
                node, skipped, articles, header = top()
                t = " ".join(unescape("".join(text)).split())
                if t and not skipped:
                    self.blocks.append((node or self.node(0, "body"), t, linked / max(1, len(t)), 0 if articles else header))
                text.clear()
            linked = 0

        def pop_to(i: int) -> None:
            flush()
            while len(stack) > i:
                opened[stack.pop()[0]] -= 1

        def find(tags, stop=(), inline: bool = False) -> int:
            """The place of the innermost such element, -1 beyond one of `stop` (any block, if inline)."""
            if any(opened.get(t) for t in tags):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in tags:
                        return i
                    if stack[i][0] in stop or inline and stack[i][1]:
                        return -1
            return -1

        for kind, tag, found, slash in tokens(html):
            if kind == "text":
                text.append(found)
                linked += len(found) if opened.get("a") else 0
            elif kind == "close":
                i = find((tag,), inline=tag in INLINE)
                if tag in INLINE:
                    if i >= 0 and i == len(stack) - 1 and stack[i][3] == (stack[i - 1][3] if i else 0):
                        opened[stack.pop()[0]] -= 1
                    elif i >= 0:
                        flush()  # what stands within an inline element that is no text, or is misnested
                        skipped = (stack[i - 1][3] if i else 0) - stack[i][3]
                        opened[tag] -= 1
                        rest = [(t, b, n, k + skipped, *more) for t, b, n, k, *more in stack[i + 1 :]]
                        del stack[i:]
                        stack += rest
                elif i >= 0:
                    pop_to(i)
                else:
                    flush()
            elif kind == "open":
                if tag in VOID:
                    if tag == "br":
                        text.append(" ")
                    elif tag == "hr":
                        flush()
                    continue
                block = tag not in INLINE
                if block:
                    flush()
                    if tag in CLOSES_P and opened.get("p"):
                        i = find(("p",), inline=True)
                        if i >= 0:
                            pop_to(i)
                    if tag in SIBLINGS:
                        i = find(SIBLINGS[tag], SCOPES.get(tag, ()))
                        while i >= 0:
                            pop_to(i)
                            i = find(SIBLINGS[tag], SCOPES.get(tag, ())) if tag == "tr" else -1
                if slash and block and tag not in CONTAINERS:
                    continue
                bad, header, classes = _unwanted(tag, found)
                node, skipped, articles, above = top()
                if bad and not skipped and (tag in ("nav", "footer") or any(_named(c, FRAMES) for c in classes.split("."))):
                    self.frames.add(node or self.node(0, "body"))
                if bad and not block:
                    flush()  # a screen reader's hint, say
                if block:
                    up = node or (0 if tag in ("html", "body") else self.node(0, "body"))
                    node = self.node(up, f"{tag}.{classes}" if classes else tag)
                    articles += tag in ("article", "main")
                    above = above or (self.depth[node] if header else 0)
                stack.append((tag, block, node, skipped + bad, articles, above))
                opened[tag] = opened.get(tag, 0) + 1
        flush()

    def tag(self, node: int) -> str:
        return self.name[node].partition(".")[0]

    def path(self, node: int) -> str:
        out = []
        while node:
            out.append(self.name[node])
            node = self.parent[node]
        return " ".join(reversed(out))

    def at(self, path: str) -> int:
        """The container of a path; 0 if the page has none."""
        node = 0
        for name in path.split(" "):
            node = self.child.get((node, name), 0)
            if not node:
                return 0
        return node

    def _headed(self, node: int) -> bool:
        """Whether headers below are the container's text."""
        return node not in self.frames and self.tag(node) not in ("body", "html")

    def best(self) -> int:
        """The container that holds the page's text; 0 if there is none."""
        n = len(self.name)
        plain, headed = [0.0] * n, [0.0] * n
        for node, text, link, header in self.blocks:
            amount = len(text) * max(0.0, 1 - 1.5 * link)
            while self.depth[node] > 1 and self.tag(node) in TEXTUAL:
                node = self.parent[node]
            if header:
                while self.depth[node] >= header:
                    node = self.parent[node]
                headed[node] += amount
            else:
                plain[node] += amount
        for node in range(n - 1, 0, -1):
            plain[self.parent[node]] += plain[node]
            headed[self.parent[node]] += headed[node]
        score = [p + h if self._headed(i) else p for i, (p, h) in enumerate(zip(plain, headed, strict=True))]
        if n == 1 or max(score[1:]) <= 0:
            return 0
        kids: dict[int, list[int]] = {}
        whole = [0] * n  # the innermost container around, itself included, that isn't part of a text
        for node in range(1, n):
            up = whole[self.parent[node]]
            whole[node] = up
            if score[node] > 0 and self.tag(node) not in TEXTUAL:
                kids.setdefault(up, []).append(node)
                whole[node] = node
        at, began = 0, 0.0
        while at in kids:
            total = score[at] if at else 0.0
            fit = [k for k in kids[at] if (score[k] >= MOST * total if self.tag(k) in ("article", "main") else score[k] >= max(NEARLY_ALL * total, STILL * began))]
            if not fit:
                break
            top = max(score[k] for k in fit)
            at = max((k for k in fit if score[k] == top), key=self.path)
            began = top if not began or self.tag(at) in ("article", "main") else began
        return at

    def text(self, node: int) -> str:
        """What stands in a container."""
        below = [i == node for i in range(len(self.name))]
        for i in range(node + 1, len(below)):
            below[i] = below[self.parent[i]]
        headed = self._headed(node)
        return " ".join(t for n, t, _, header in self.blocks if below[n] and (not header or headed and header > self.depth[node]))


FRAMES = frozenset(("nav", "navbar", "navigation", "footer"))


def best_path(html: str | None) -> str | None:
    page = Page(html or "")
    best = page.best()
    return page.path(best) if best else None


def extracted(html: str | None, winners: list[str]) -> str:
    page = Page(html or "")
    own = page.best()
    if not own:
        return ""
    best = page.text(own)
    if page.path(own) in winners:
        return best
    for w in winners:
        at = page.at(w)
        t = page.text(at) if at else ""
        if 2 * len(t) >= len(best):
            return t
    return best


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))), F.lit(""))


def _read(df: DataFrame, at: int, columns: list[str], kinds: str, made) -> DataFrame:
    """made(row) for each row of few columns, the page in column `at`; a few pages at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(at).to_pylist()):
                rows = [made(*r) for r in zip(*(c.to_pylist() for c in b.slice(lo, hi - lo).columns), strict=True)]
                yield pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(columns)}, schema=schema)

    spark_schema = df.sparkSession.createDataFrame([], kinds).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark_schema)
    return df.mapInArrow(run, kinds)


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = WIN_SHARE) -> DataFrame:
    """(host, winners): each host's winning paths, most voted first; no more than 1 / share can be."""
    votes = _read(pages.select(host_of(F.col(url_col)).alias("host"), html_col), 1, ["host", "path"], "host string, path string", lambda host, html: (host, best_path(html)))
    n = cut(votes.filter("path is not null").groupBy("host", "path").count())
    total = n.groupBy("host").agg(F.sum("count").alias("total"))
    won = n.join(total, "host").filter(f"count >= total * {share}")
    return won.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "path"))), lambda x: x["path"]).alias("winners"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = WIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    paths = host_paths(pages, url_col, html_col, share)
    rows = join_hot(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host")), paths, ["host"], "left")

    def made(page, url, html, winners):
        t = extracted(html, winners or [])
        return page, url, t, len(t)

    kind = pages.schema[id_col].dataType.simpleString()
    return _read(rows.select("page_id", "url", "html", "winners"), 2, ["page_id", "url", "text", "n_chars"], f"page_id {kind}, url string, text string, n_chars bigint", made)
