"""Main text of web pages by consensus host paths.

A page's containers are scored by the text of their blocks outside links,
and the page votes for its best container's generalised path (tags with
classes, digits as #).  Votes are counted per host in Spark; every page is
then extracted again from the containers at its host's winning path (the
next best that the page has, its own best container if it has none of them)
and what belongs to them around: the rest of their article, or the ancestors
that add text.  Containers marked by class or id words are left out unless
they hold the article or most of the text.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.batches import text_slices
from wordloom.session import checked_broadcast

# Elements without main text, elements that contain blocks, and elements that are blocks themselves.
SKIPPED = set("nav header footer aside button select menu dialog input".split())
CONTAINERS = set("html body main article section div td th tr tbody thead table center blockquote figure details fieldset form ul ol dl".split()) | SKIPPED
BLOCKS = set("p h1 h2 h3 h4 h5 h6 li dt dd pre address summary caption figcaption hr".split())
# Containers that structure a text; a `div` may hold anything.
STRUCTURE = set("section blockquote figure details ul ol dl table tbody thead tr td th".split())
# Elements that are left out with their content.  HTML reads the first group as raw text, to the end of the page if nothing closes them.
RAW_TEXT = set("script style textarea title".split())
RAW = "script|style|noscript|template|iframe|svg|textarea|select|object|canvas|math|title"
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW.split("|")}
# Where a title that nothing closes ends, and where HTML ends an svg or math element that nothing closes before.
HEAD_END = re.compile(r"</head(?=[\s>])|<body(?=[\s/>])", re.I)
BREAKOUT = re.compile(r"<(?:(/?)(?:svg|math)|(foreignobject|annotation-xml|desc|title)|body|div|p|h[1-6]|ul|ol|dl|li|table|blockquote|pre|center|hr|br)(?=[\s/>])", re.I)
# Words of class and id values that mark an element as no main text, and how others say that an element has or lacks one.
BOILERPLATE = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent\w*|notice\w*|sidebar\w*|menu\w*|nav|navbar\w*|navigation|"
    r"breadcrumb\w*|footer\w*|header|masthead|comment\w*|replies|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe\w*|"
    r"popup|modal|widget\w*|toolbar|pagination|pager|login|signup|search)(?:$|[^a-z])")
MODIFIED = re.compile(r"(?:^|(?<=[^a-z]))(?:has|no|with|without)[-_]+[a-z]+")
# What text in marked containers counts in the score.
MARKED_WORTH = 0.25
ATTRIBUTES = r"""(?:[^>"']++|"[^"<]*+"|'[^'<]*+')*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])({ATTRIBUTES})>"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+>|<[!?][^>]*+>", re.S | re.I)
MARKS = re.compile(r"""(?:^|\s)(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Levels of a path that are kept, from the container upwards.
PATH_DEPTH = 6


class _Raw:
    """Ends of the elements that are left out with their content; what isn't found behind one place isn't searched again."""

    def __init__(self, source: str):
        self.source, self.without = source, {}

    def _find(self, pattern: re.Pattern, at: int):
        if self.without.get(pattern, len(self.source) + 1) <= at:
            return None
        m = pattern.search(self.source, at)
        if m is None:
            self.without[pattern] = at
        return m

    def end(self, tag: str, attributes: str, at: int) -> int:
        """Where the element ends whose opening tag ends at ``at``; ``at`` itself for an empty one and one that nothing closes."""
        if tag not in RAW_TEXT and attributes.endswith("/"):
            return at
        if tag in ("svg", "math"):
            stop = BREAKOUT.search(self.source, at)
            if stop and stop[1] is None and stop[2] is None:
                return stop.start()
        m = self._find(ENDS[tag], at)
        if m:
            return m.end()
        if tag == "title":
            m = self._find(HEAD_END, at)
            return m.start() if m else len(self.source)
        return len(self.source) if tag in RAW_TEXT else at


class Page:
    """Containers of a page and its blocks of text in page order.

    ``paths[i]``, ``tags[i]``, ``parents[i]`` and ``spans[i]`` (first block,
    one past the last) belong to container i, ``guards[i]`` is the innermost
    container at or above it that is marked as no main text (-1 without
    one); a block is (container, text, characters in links, is an element).
    """

    def __init__(self, source: str):
        self.paths, self.tags, self.parents, self.spans, self.blocks = ["body"], ["body"], [-1], [[0, None]], []
        self.marked = [False]
        stack = [("body", 0, False, ["body"])]  # tag, container, skipped, path
        text, linked, in_link, at, element = [], 0, 0, 0, False

        def flush():
            nonlocal linked
            if text:
                joined = " ".join(html.unescape("".join(text)).split())
                if joined and not stack[-1][2]:
                    self.blocks.append((stack[-1][1], joined, min(linked, len(joined)), element))
                text.clear()
                linked = 0

        raw, going = _Raw(source), True
        while going:
            going = False
            for m in TOKEN.finditer(source, at):
                piece = source[at:m.start()]
                if piece:
                    text.append(piece)
                    if in_link:
                        linked += len(piece)
                at = m.end()
                if m[1]:
                    end = raw.end(m[1].lower(), m[2], at)
                    if end > at:
                        at, going = end, True
                        break
                    continue
                if m[4]:
                    closing, tag, attributes = m[3], m[4].lower(), m[5]
                elif m[7]:
                    closing, tag, attributes = m[6], m[7].lower(), ""
                else:
                    continue
                if tag in CONTAINERS:
                    flush()
                    element = False
                    if tag in ("html", "body"):
                        continue
                    if closing:
                        self._close(stack, tag)
                    else:
                        self._open(stack, tag, attributes)
                elif tag in BLOCKS:
                    flush()
                    element = not closing and tag != "hr"
                elif tag == "br":
                    text.append(" ")
                elif tag == "a":
                    in_link = 0 if closing else 1
        if source[at:]:
            text.append(source[at:])
        flush()
        for span in self.spans:
            span[1] = len(self.blocks) if span[1] is None else span[1]
        self._judge()

    def _open(self, stack, tag, attributes):
        if tag == "input":
            return
        marks = [(k.lower(), next(v for v in values if v or v == "")) for k, *values in MARKS.findall(attributes)] if "=" in attributes else []
        value = {k: " ".join(sorted(v.lower().split())) for k, v in marks}
        skipped = stack[-1][2] or tag in SKIPPED
        name = tag + "".join("." + c for c in re.sub(r"[0-9]+", "#", value.get("class", "")).split())
        path = [*stack[-1][3][1 - PATH_DEPTH:], name]
        self.paths.append(">".join(path))
        self.tags.append(tag)
        self.parents.append(stack[-1][1])
        self.spans.append([len(self.blocks), None])
        self.marked.append(tag == "form" or any(BOILERPLATE.search(MODIFIED.sub("", v)) for v in value.values()))
        stack.append((tag, len(self.paths) - 1, skipped, path))

    def _close(self, stack, tag):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                for _, c, _, _ in stack[i:]:
                    self.spans[c][1] = len(self.blocks)
                del stack[i:]
                return

    def _judge(self):
        """Settle which marked containers are boilerplate: none that is or holds the main element or the largest article, and none that holds most of the text, unless it lies beside those."""
        worth = [max(0, len(text) - 2 * linked) for _, text, linked, _ in self.blocks]
        total = [0]
        for w in worth:
            total.append(total[-1] + w)
        self.worth, self.total = worth, total
        if any(self.marked):
            inside = [total[last] - total[first] for first, last in self.spans]
            candidates = [i for i, tag in enumerate(self.tags) if tag in ("main", "article") and inside[i]]
            kept = [i for i in candidates if self.tags[i] == "main"]
            articles = [i for i in candidates if self.tags[i] == "article"]
            if articles:
                kept.append(max(articles, key=lambda i: (inside[i] * (MARKED_WORTH if self.marked[i] else 1), -i)))
            for i in kept:
                while i >= 0:
                    self.marked[i] = False
                    i = self.parents[i]
            held = set(kept)
            for i, p in enumerate(self.parents):  # parents come first
                if p in held:
                    held.add(i)
            for i, w in enumerate(inside):
                if 2 * w > total[-1] and (not kept or i in held):
                    self.marked[i] = False
        self.guards = [-1]
        for i in range(1, len(self.paths)):
            self.guards.append(i if self.marked[i] else self.guards[self.parents[i]])

    def best(self) -> tuple[int, float]:
        """The container with the highest score: text outside links, in full for a block's own container, half and a quarter above it."""
        score = [0.0] * len(self.paths)
        for (c, _, _, _), worth in zip(self.blocks, self.worth):
            worth = float(worth)
            if self.guards[c] >= 0:
                worth *= MARKED_WORTH
            for _ in range(3):
                if c < 0:
                    break
                score[c] += worth
                worth /= 2
                c = self.parents[c]
        top = max(range(len(score)), key=lambda i: (score[i], -i))
        return top, score[top]

    def text(self, winners: list[str]) -> str:
        for path in winners:
            picks = [i for i, p in enumerate(self.paths) if p == path]
            got = self._join(picks)
            if got:
                return got
        top, score = self.best()
        return self._join([top]) if score > 0 else ""

    def _kept(self, c: int, first: int | None = None, last: int | None = None) -> list[int]:
        """The blocks of container c (from ``first`` to ``last``) that lie in no marked container below it."""
        a, z = self.spans[c]
        guard = self.guards[c]
        return [i for i in range(a if first is None else first, z if last is None else last) if self.guards[self.blocks[i][0]] == guard]

    def _whole(self, c: int) -> int:
        """The container that holds the rest of c's text: within an article or main element any text outside links
        is the rest, elsewhere text in elements of the parent, in lists, sections and quotes, and large containers beside c."""
        enclosing, i = -1, c
        while i >= 0 and self.guards[i] == self.guards[c]:
            if self.tags[i] in ("article", "main"):
                enclosing = i
            i = self.parents[i]
        if enclosing >= 0:
            return enclosing
        p = self.parents[c]
        while p >= 0 and self.guards[p] == self.guards[c]:
            (first, last), (a, z) = self.spans[c], self.spans[p]
            beside = [i for i in self._kept(p, a, first) + self._kept(p, last, z) if self.worth[i]]
            if beside and not self._belongs(c, p, beside):
                break
            if beside or p:
                c = p
            p = self.parents[p]
        return c

    def _belongs(self, c: int, p: int, beside: list[int]) -> bool:
        large = 0
        for i in beside:
            x, child = self.blocks[i][0], -1
            while x != p:
                x, child = self.parents[x], x
            if self.blocks[i][3] if child < 0 else self.tags[child] in STRUCTURE:
                return True
            large += self.worth[i] if p else 0  # beside a container of the body stands anything
        return large * 10 >= self.total[self.spans[c][1]] - self.total[self.spans[c][0]] and large > 0

    def _join(self, containers: list[int]) -> str:
        if not any(self._kept(c) for c in containers):
            return ""
        out, until = [], 0
        for c in sorted({self._whole(c) for c in containers}, key=lambda c: (self.spans[c][0], -self.spans[c][1])):
            first, last = self.spans[c]
            out += [self.blocks[i][1] for i in self._kept(c, max(first, until))]
            until = max(until, last)
        return "\n".join(out)


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: int = 8) -> DataFrame:
    """(host, paths): each host's container paths by number of votes, then by text, then by name; the best ``keep``.

    A page without any scored container does not vote.
    """
    def run(batches):
        for b in batches:
            for a, z in text_slices(b, "html"):
                hosts, best = b.column("host").slice(a, z - a), []
                for source in b.column("html").slice(a, z - a).to_pylist():
                    page = Page(source or "")
                    top, score = page.best()
                    best.append((page.paths[top], score))
                yield pa.RecordBatch.from_arrays([hosts, pa.array([p for p, _ in best], pa.string()), pa.array([s for _, s in best], pa.float64())],
                                                 ["host", "path", "score"])

    votes = pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")) \
        .mapInArrow(run, "host string, path string, score double").where("score > 0") \
        .groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path"))
    return votes.withColumn("rank", rank).where(F.col("rank") <= keep).groupBy("host") \
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of every row, empty if there is none.

    Null and empty pages give an empty text; a null url is a host of its own.
    Rows are kept as they are, repeated ones too.
    """
    winners = host_paths(pages, url_col, html_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), _host(F.col(url_col)).alias("host"))

    def run(batches):
        for b in batches:
            for a, z in text_slices(b, "html"):
                part = b.slice(a, z - a)
                texts = [Page(source or "").text(paths or []) for source, paths in zip(part.column("html").to_pylist(), part.column("paths").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 ["id", "url", "text", "n_chars"])

    joined = rows.join(checked_broadcast(winners, max_rows=50_000), "host", "left").select("id", "url", "html", "paths")
    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
