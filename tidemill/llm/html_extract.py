"""Main text of web pages by consensus over each host's container paths.

A page's containers are scored by the text that they hold outside menus,
headers, adverts and the like; from the innermost one that holds nearly all of
it, the smallest around that one, below the body, that leaves nothing out gets
the page's vote, under its path of tags and generalised classes. Spark
adds the votes up by host. The pages are then read again with the paths that
their host has chosen, each template's own; a page without any of them falls
back to its own vote.

A name is a hint, not a verdict. What a name or a form element marks stays if
it holds most of the page's prose, or if nothing else would be left; a mere word
such as "related" counts only where most of the text is links.

Defined results: a null or empty page, or one without such text, has an empty
text; pages without a host vote together; repeated rows vote and come out
repeated. Unclosed tags, stray end tags and cut-off pages are read as far as
they go; white space of any kind inside a block becomes one space.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm._shared import arrow_schema, batch_of, materialize, slices
from tidemill.llm.url_rules import host_and_path

#: The part of a page's good text that the container voted for must hold.
ENOUGH = 0.8
#: The part of a host's most frequent path's votes that another path needs to be one of its templates, and how many there are at most.
TEMPLATE, TEMPLATES = 0.2, 8
#: Bytes of hosts and winning paths up to which these are broadcast; more are joined by host.
MAX_SENT = 16_000_000

# Fixed values of HTML: elements whose content is no text of the page (the first
# ones up to the end of a page that is cut off), that hold other blocks, that end
# a block, and that may be left open.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title"}
SILENT = RAW | {"svg", "select", "button", "object", "canvas"}
HOLDERS = {"html", "head", "body", "div", "article", "section", "main", "aside", "nav", "header", "footer", "form", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "ul", "ol", "dl", "li", "dd", "dt", "figure", "fieldset", "details", "dialog", "menu", "center", "blockquote", "hgroup", "search"}
BREAKS = HOLDERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "address", "figcaption", "caption", "summary", "legend", "hr", "option"}
REOPENED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"}}

#: Elements, names and roles of what is not the article.
APART_TAGS = {"head", "nav", "aside", "footer", "menu", "dialog", "search"}
FORM_TAGS = {"form", "fieldset"}
APART_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "alert", "alerts", "banner", "billboard", "branding", "breadcrumb", "breadcrumbs", "captcha", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "form", "gdpr", "hidden", "login", "logo", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "outbrain", "overlay", "pager", "pagination", "paywall", "popular", "popup", "promo", "promos", "promoted", "promotion", "recommended", "recommendations", "related", "reply", "replies", "respond", "search", "share", "sharing", "sidebar", "signin", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "taboola", "tagcloud", "tags", "teaser", "toolbar", "topbar", "topnav", "trending", "widget", "widgets"}
#: Beginnings of such words, as names are often written in one, but for what else begins so.
APART_STARTS = ("advert", "breadcrumb", "commentl", "commentb", "commentf", "commentt", "cookie", "footer", "navbar", "newsletter", "promo", "recommend", "relatedp", "sidebar", "sponsor", "subscri")
#: What may stand beside such a word in a name; with any other word beside it the name is of something else.
BESIDE = {"area", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "cards", "col", "column", "contact", "container", "content", "contents", "desktop", "email", "fixed", "float", "global", "group", "holder", "icon", "icons", "inline", "inner", "item", "items", "left", "link", "links", "list", "local", "main", "mobile", "module", "most", "outer", "page", "panel", "posts", "primary", "reader", "region", "right", "row", "secondary", "section", "side", "site", "slot", "sticky", "stories", "strip", "thread", "top", "unit", "user", "view", "wrap", "wrapper", "zone"}
#: Of these words, those for readers' comments, and those for lists of articles.
COMMENTS = ("comment", "disqus", "repl", "respond")
LISTS = {"popular", "recommended", "recommendations", "related", "tagcloud", "tags", "teaser", "trending"}
LIST_STARTS = ("recommend", "relatedp")
ARTICLES = {"article", "blog", "entry", "post", "story"}
APART_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
#: The parts of a list of articles that is links, and of a page's prose that no mark by a name outweighs.
LISTED, MOST = 0.5, 0.5
#: Characters of prose from which what is named apart may be the page's article, and of a block from which it reads like prose whatever holds it.
GOOD, SENTENCE = 140, 80
#: The part of a block that is links above which, outside paragraphs and headings, it may be a menu.
LINKED = 0.8
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"}
WHOLE = {"html", "body", "article", "main"}
INLINE = {"span", "em", "strong", "b", "i", "u", "small", "big", "font", "ins", "mark", "label", "sub", "sup", "cite"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in SILENT}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def general(name: str) -> str:
    """A class without what changes from page to page: digits become one sign."""
    return re.sub(r"\d+", "#", name.lower()).replace("/", "|")


#: How a container is marked: not at all; by its element, role or attributes; by a name, as comments, a list or anything else; or as a form.
NOT, SURELY, COMMENTED, MAYBE, LIST, NAMED, FORM = range(7)


def named(name: str) -> int:
    """What a class or id says of a container: one of the words, with nothing else than ``BESIDE`` around it."""
    parts = [x.lower() for x in _PART.findall(name)]
    of = [x in APART_WORDS or x.startswith(APART_STARTS) for x in parts]
    if "".join(parts) not in APART_WORDS and not (any(of) and all(a or x in BESIDE or x in ARTICLES for a, x in zip(of, parts, strict=True))):
        return NOT
    said = [x for a, x in zip(of, parts, strict=True) if a] or ["".join(parts)]
    if any(x.startswith(COMMENTS) for x in said):
        return COMMENTED
    if not all(x in LISTS or x.startswith(LIST_STARTS) for x in said):
        return NAMED
    return LIST if len(said) < len(parts) else MAYBE


def names_header(name: str) -> bool:
    parts = [x.lower() for x in _PART.findall(name)]
    return "header" in parts and all(x == "header" or x in BESIDE for x in parts)


class Page:
    """Blocks of text, each within a container; containers by parent, label, and whether they stand apart or in an article.

    Time and memory are in proportion to the page, however deep it is: only
    the path of the container voted for is written out.
    """

    def __init__(self, html: str):
        self.parent, self.label, self.mark, self.inside = [-1], [""], [NOT], [False]
        self.blocks: list[tuple[int, str, int, str]] = []  # container, text, characters in links, kind
        self._read(html)
        self.apart = self._set_apart()

    def _below(self, amounts: list[int]) -> list[int]:
        """Each container's amount and that of all within it."""
        for k in range(len(amounts) - 1, 0, -1):  # parents come first
            amounts[self.parent[k]] += amounts[k]
        return amounts

    def _set_apart(self) -> list[bool]:
        """Which containers stand apart: marks by name give way to links, to most of the page's prose, and to an empty page."""
        n = len(self.parent)
        surely = [False] * n
        for k in range(1, n):
            surely[k] = surely[self.parent[k]] or self.mark[k] == SURELY
        size, linked, prose = [0] * n, [0] * n, [0] * n
        for holder, text, links, kind in self.blocks:
            size[holder] += len(text)
            linked[holder] += links
            if not surely[holder] and (kind in PROSE or len(text) >= SENTENCE):
                prose[holder] += len(text) - links
        size, linked, prose = map(self._below, (size, linked, prose))
        marks = [0] * n  # how many marks by name there are on the way to each
        for k in range(1, n):
            mark = self.mark[k]
            little = prose[k] <= MOST * prose[0]
            counts = mark == COMMENTED or (mark == MAYBE and linked[k] > LISTED * size[k]) or (mark in (LIST, FORM) and little) or (mark == NAMED and (little or prose[k] < GOOD))
            marks[k] = marks[self.parent[k]] + counts
        left = Counter()  # prose by the number of marks
        for holder, text, links, kind in self.blocks:
            if not surely[holder] and len(text) > links:
                left[marks[holder]] += len(text) - links if kind in PROSE else 0
        fewest = 0 if 0 in left else min((m for m, some in left.items() if some >= GOOD), default=0)
        return [surely[k] or marks[k] > fewest for k in range(n)]

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        open_, endless = Counter(), set()
        run: list[str] = []
        linked, in_link, kind, at = 0, False, "", 0
        own, muted, depth = -1, "", 0  # a block's container of its own; an inline element that stands apart, and how deep it is nested

        def text_to(end: int) -> None:
            nonlocal linked
            if end > at and not muted:
                piece = html[at:end]
                piece = unescape(piece) if "&" in piece else piece  # a reference does not go on behind a tag
                run.append(piece)
                if in_link:
                    linked += len(piece.strip())

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self.blocks.append((stack[-1][1] if own < 0 else own, text, min(linked, len(text)), kind))
                run.clear()
            linked = 0

        def pop() -> None:
            open_[stack.pop()[0]] -= 1

        begin, last = 0, html.rfind(">") + 1  # no tag ends behind the last one, and none is looked for
        while m := _TOKEN.search(html, begin, last):
            text_to(m.start())
            at = begin = m.end()
            tag = m[2] or m[5]
            if tag is None:
                if html.startswith("<!--", m.start()) and not html.endswith("-->", m.start() + 4, at):
                    at = begin = len(html)  # a comment without an end
                continue
            tag, closing, rest = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if tag in SILENT:
                if not closing and not (rest.endswith("/") and tag == "svg") and tag not in endless:
                    end = _ENDS[tag].search(html, at)
                    if end:
                        at = begin = end.end()
                    elif tag in RAW:
                        at = begin = len(html)
                    else:
                        endless.add(tag)  # open to the end: its content is read as the page's
                continue
            if tag not in BREAKS:
                if muted:
                    depth += (tag == muted) * (-1 if closing else 1)
                    muted = muted if depth else ""
                elif tag == "a":
                    in_link = not closing
                elif tag == "br":
                    run.append(" ")
                elif tag in INLINE and not closing and rest and self._names(rest)[0] == NAMED:
                    muted, depth = tag, 1
                continue
            flush()
            in_link, own, muted = False, -1, ""
            kind = "" if closing else tag
            if tag not in HOLDERS:
                if not closing and rest and self._names(rest)[0]:
                    own = self._holder(tag, rest, stack[-1][1])
                continue
            if closing:
                if open_[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                continue
            while stack[-1][0] in REOPENED.get(tag, ()):
                pop()
            if not rest.endswith("/"):
                stack.append((tag, self._holder(tag, rest, stack[-1][1])))
                open_[tag] += 1
        comment = html.find("<!--", at)
        text_to(comment if comment >= 0 else len(html))
        flush()

    @staticmethod
    def _names(rest: str) -> tuple[int, dict[str, str], list[str]]:
        """What an element's class and id say, and its attributes and classes."""
        given: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(rest) if rest else ():
            given.setdefault((m[1] or m[5]).lower(), unescape(m[2] or m[3] or m[4] or ""))
        classes = sorted(set(given.get("class", "").split()))
        return min((m for m in map(named, [*classes, given.get("id", "")]) if m), default=NOT), given, classes

    def _holder(self, tag: str, rest: str, above: int) -> int:
        mark, given, classes = self._names(rest)
        inside = self.inside[above]
        if tag in WHOLE:
            mark = NOT
        elif not mark and tag in FORM_TAGS:
            mark = FORM
        headed = not inside and tag not in WHOLE and (tag == "header" or any(map(names_header, [*classes, given.get("id", "")])))
        if headed or tag in APART_TAGS or given.get("role", "").lower() in APART_ROLES or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
            mark = SURELY
        self.parent.append(above)
        self.label.append(".".join([tag, *map(general, classes)]))
        self.mark.append(mark)
        self.inside.append(inside or tag in ("article", "main"))
        return len(self.parent) - 1

    def path(self, k: int) -> str:
        labels = []
        while k > 0:
            labels.append(self.label[k])
            k = self.parent[k]
        return "".join(f"/{x}" for x in reversed(labels))

    def _held(self) -> list[float]:
        """The good text within each container."""
        held = [0.0] * len(self.parent)
        for holder, text, linked, kind in self.blocks:
            if not self.apart[holder]:
                held[holder] += (len(text) - linked) * (1.0 if kind in PROSE else 0.5)
        return self._below(held)

    def _chosen(self) -> tuple[int, float]:
        """The container voted for, and the part of the good text that it holds.

        From the innermost one that holds enough, it climbs below the body to
        the smallest that holds all that any around it holds.
        """
        held = self._held()
        if not held[0]:
            return 0, 0.0
        chosen = max(k for k in range(len(held)) if held[k] >= ENOUGH * held[0])
        k = self.parent[chosen]
        while k > 0 and self.label[k].partition(".")[0] not in ("html", "body"):
            if held[k] > held[chosen]:
                chosen = k  # the rest of the article lies beside what holds most of it
            k = self.parent[k]
        return chosen, held[chosen] / held[0]

    def vote(self) -> tuple[str, float]:
        chosen, share = self._chosen()
        return self.path(chosen), share

    def _of_path(self, path: str) -> list[int]:
        """The containers of this path."""
        labels, depth, found = path.split("/")[1:], {0: 0}, []
        if not labels:
            return [0]
        for k in range(1, len(self.parent)):  # parents come first
            d = depth.get(self.parent[k])
            if d is not None and self.label[k] == labels[d]:
                if d + 1 == len(labels):
                    found.append(k)
                else:
                    depth[k] = d + 1
        return found

    def text(self, *paths: str) -> str:
        """The blocks within containers of the path, of several the one that holds most, without what stands apart.

        The own vote counts if there is none, or if it lies in an article
        while those of the path lie elsewhere. Blocks of links are menus
        before and behind the prose, but part of an article's element and of
        what stands between prose.
        """
        held, (own, _) = self._held(), self._chosen()
        roots = max((self._of_path(p) for p in paths), key=lambda found: sum(held[k] for k in found))
        within = [False] * len(self.parent)
        for k in roots or [own]:
            within[k] = True
        for k in range(1, len(within)):
            within[k] = within[k] or within[self.parent[k]]
        if roots and not within[own] and self.inside[own] and not any(self.inside[k] for k in roots):
            return self.text(self.path(own))
        blocks = [b for b in self.blocks if within[b[0]] and not self.apart[b[0]]]
        menu = [kind not in PROSE and linked > LINKED * len(text) and not self.inside[holder] for holder, text, linked, kind in blocks]
        prose = [k for k, m in enumerate(menu) if not m]
        return "\n".join(b[1] for b in blocks[prose[0] : prose[-1] + 1]) if prose else ""


def votes(pages: DataFrame, html: str = "html", host: str = "host") -> DataFrame:
    """(host, path, votes): what each host's pages vote for, by the part of their text that it holds."""
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType(), False), T.StructField("share", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in slices(batches):
            found = [Page(h.as_py() or "").vote() for h in batch.column(1)]
            yield batch_of(target, [batch.column(0), [p for p, _ in found], [s for _, s in found]])

    one = pages.select(F.col(host).alias("host"), F.col(html).alias("html")).mapInArrow(run, schema)
    # whole numbers add up to the same sum in any order
    return one.where("share > 0").groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1_000_000).cast("long")).alias("votes"))


def winners(counted: DataFrame) -> DataFrame:
    """(host, paths): the paths of its templates, that with most votes first, then the longest, then the last by name."""
    most = counted.groupBy("host").agg(F.max("votes").alias("most"))
    likely = counted.join(most.withColumnRenamed("host", "__h"), F.col("host").eqNullSafe(F.col("__h"))).where(F.col("votes") >= TEMPLATE * F.col("most"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc(F.length("path")), F.desc("path"))
    first = likely.withColumn("r", F.row_number().over(order)).where(F.col("r") <= TEMPLATES)
    return first.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None, max_sent: int = MAX_SENT) -> DataFrame:
    """``keep``, text and n_chars of every page."""
    keep = ["page_id", url] if keep is None else keep
    rows = pages.select(F.struct(*keep).alias("row"), host_and_path(F.col(url))[0].alias("host"), F.col(html).alias("html"))
    chosen = materialize(winners(votes(rows)), "paths")
    size = chosen.agg(F.sum(F.aggregate("paths", F.lit(0), lambda n, p: n + F.octet_length(p)) + F.coalesce(F.octet_length("host"), F.lit(0)) + 32)).first()[0] or 0
    sent = size <= max_sent
    joined = rows.join(F.broadcast(chosen) if sent else chosen, "host", "left").select("row", "paths", "html")
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in slices(batches):
            texts = [Page(h).text(*(p or ["/"])) if h else "" for p, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield batch_of(target, [batch.column(0), texts, [len(t) for t in texts]])

    return joined.mapInArrow(run, schema).select(*(F.col("row")[k].alias(k) for k in keep), "text", "n_chars")
