"""HTML extraction by site style trees.

The pages of one host are merged into one tree: its element nodes are tag paths (with classes and ids, digits in
them alike), its style and content nodes the different instances seen there: child sequence and text, composed from
the leaves upwards. Of n different pages with a path, c have an instance; its importance is 1 - log c / log n, the
complement of its entropy over the pages: what stands alike on all pages says nothing, what stands on one says all.
A branch goes where it and all below it are unimportant, so no branch is taken out for what other pages have in its
place. An article or main element is a prior and no cut: within it less importance is enough to stay, beside
it more is needed, and branches of links beside it go. Branches that name their role by tag, role, class or id go too.

Copies of a page (of its article's text, where that is most of it) count once. Instances on less than a quarter of
the pages and paths of fewer than 8 different pages are never unimportant; html, body and what holds an article
are never taken out whole; and a page that would keep less than a quarter of its words is a near copy
of others rather than their frame, and keeps all its branches.

The tree is kept as counts: (host, path, instance, page) are made distinct and counted by Spark with partial sums,
so a hot host spreads over many tasks; what is joined back to the pages is the short list of repeated instances.

Null and empty html gives an empty text, as does html without blocks. Null URLs are a host of their own.
Repeated rows each give a row; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.llm.common import settle

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset(
    "head title script style noscript template iframe object svg math canvas nav header footer aside form button select "
    "option textarea input label dialog menu audio video map".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
DIGITS = re.compile(r"\d+")
#: Words of class and id names that mark a branch as no part of the article.
NAMES = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|advert\w*|adsense|banner|promo\w*|sponsor\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|header|masthead|footer|"
    r"side|sidebar\w*|aside|widgets?|notices?|cookies?\w*|consent|gdpr|alert|popup|modal|newsletter|subscribe|signup|login|search|form|"
    r"comments?|comment-?list|disqus\w*|replies|reply|responses|respond|related|recommend\w*|share|sharing|social|toolbar|skip)(?:$|[-_ ])", re.I)


#: Least importance that stays: in an article, on a page without one, and beside one.
IN_CORE, ALONE, BESIDE = 0.1, 0.2, 0.5
MIN_PAGES, MIN_SHARE = 8, 0.25


class Node:
    __slots__ = ("tag", "path", "children", "skip", "core", "name", "words", "links", "holds", "instance")

    def __init__(self, tag: str, path: str, skip: bool, core: bool, name: str) -> None:
        self.tag, self.path, self.skip, self.core, self.name = tag, path, skip, core, name
        self.children: list[Node | str] = []


class Tree(HTMLParser):
    """The page's elements; unclosed paragraphs, items and cells end where html says."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", "", False, False, "")
        self.stack = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs) -> None:
        known = dict(attrs)
        if tag in BLOCKS:
            self._end_open({"p"}, BLOCKS - {"p"})
        if tag in CLOSES:
            self._end_open(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
        names = " ".join(f"{known.get('class') or ''} {known.get('id') or ''}".split())
        top = self.stack[-1]
        core = top.core or tag in ("article", "main") or known.get("role") in ("main", "article")
        skip = top.skip or tag in SKIPPED or known.get("role") in ROLES or "hidden" in known or (
            tag not in ("html", "body", "article", "main") and bool(NAMES.search(names)))
        if tag == "header" and top.core and not top.skip:
            skip = True
        name = f"{tag}.{DIGITS.sub('0', names)}" if names else tag
        node = Node(tag, f"{top.path}/{name}" if len(self.stack) < 60 else top.path, skip, core, name)
        top.children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style", "svg", "math") and self.stack[-1].tag == tag:
            self.stack.pop()

    def _end_open(self, tags: set[str], stop: set[str]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return
            if self.stack[i].tag in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in node.children if isinstance(c, Node)]


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1


def measure(root: Node) -> list[Node]:
    """Words, words in links, articles below and instance of every element that its name leaves; parents first."""
    order = list(walk(root))
    for node in reversed(order):  # children before parents
        node.words, node.links, node.holds, node.instance = 0, 0, False, 0
        if node.skip:
            continue
        parts = [node.path]
        for c in node.children:
            if isinstance(c, str):
                words = c.split()
                node.words += len(words)
                parts += words
            elif not c.skip:
                node.words += c.words
                node.links += c.links
                node.holds |= c.holds or (c.core and not node.core)
                parts.append(f"<{c.name} {c.instance}>")
        if node.tag == "a":
            node.links = node.words
        node.instance = digest(" ".join(parts))
    return order


def text_blocks(root: Node, low: Iterable[tuple[int, float]]) -> list[str]:
    """Blocks of the page in order, white space made one space; `low` has (instance, importance)."""
    importance = dict(low)
    order = measure(root)
    core = any(n.core and n.words for n in order)
    gone: set[int] = set()
    for node in reversed(order) if importance else ():
        limit = IN_CORE if node.core else BESIDE if core else ALONE
        if (node.words and not node.holds and node.tag not in ("html", "body") and importance.get(node.instance, 1.0) < limit
                and all(isinstance(c, str) or not c.words or id(c) in gone for c in node.children)):
            gone.add(id(node))
    out, kept = _blocks(root, core, gone)
    return out if not gone or kept >= MIN_SHARE * _blocks(root, core, set())[1] else _blocks(root, core, set())[0]


def _blocks(root: Node, core: bool, gone: set[int]) -> tuple[list[str], int]:
    """The blocks without the branches `gone`, and their words."""
    out, line, kept = [], [], 0

    def end() -> int:
        words = "".join(line).split()
        line.clear()
        if words:
            out.append(" ".join(words))
        return len(words)

    todo: list[tuple[Node | str | None, bool]] = [(root, core)]
    while todo:
        item, beside = todo.pop()
        if item is None:
            kept += end()
        elif isinstance(item, str):
            line.append(item)
        elif item.skip or id(item) in gone or (beside and item.tag in BLOCKS and not item.core and not item.holds and 2 * item.links > item.words):
            if item.tag in BLOCKS:
                kept += end()
        else:
            if item.tag == "br":
                line.append(" ")
            if item.tag in BLOCKS:
                kept += end()
                todo.append((None, False))
                beside = beside and item.holds  # a branch beside the article is judged as one
            todo += [(c, beside) for c in reversed(item.children)]
    return out, kept + end()


def observations(page: str | None) -> tuple[int, set[tuple[int, int]]]:
    """The page's text as a number, and the (path, instance) of its elements with words; instance -1 for the path itself."""
    root = Tree(page or "").root
    order = measure(root)
    texts: tuple[list[str], list[str]] = ([], [])  # of all, of articles
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        item, inside = todo.pop()
        if isinstance(item, str):
            texts[0].extend(item.split())
            if inside:
                texts[1].extend(item.split())
        elif not item.skip:
            todo += [(c, item.core) for c in reversed(item.children)]
    text = " ".join(texts[2 * len(texts[1]) >= len(texts[0])])
    seen = set()
    for node in order:
        if node.words and node.path:
            path = digest(node.path)
            seen |= {(path, -1), (path, node.instance)}
    return digest(text), seen


def low_branches(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, low): per host, (instance, importance) of its repeated instances."""

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[tuple[str, int], set] = {}
            for h, page in zip(b["host"], b["html"]):
                text, found = observations(page)
                seen.setdefault((h, text), set()).update(found)
            rows = [(h, text, *o) for (h, text), found in seen.items() for o in found]
            yield pd.DataFrame(rows, columns=["host", "page", "path", "instance"])

    counted = pages.select("host", "html").mapInPandas(observe, "host string, page long, path long, instance long").groupBy(
        "host", "path", "instance").agg(F.count_distinct("page").alias("c")).where(F.col("c") > min_share * min_pages)
    counted = settle(counted, "instances")
    paths = counted.where((F.col("instance") == -1) & (F.col("c") >= min_pages)).select("host", "path", F.col("c").alias("n"))
    importance = 1 - F.log("c") / F.log("n")
    return (
        counted.where("instance <> -1").join(paths, ["host", "path"])
        .where((importance < BESIDE) & (F.col("c") >= min_share * F.col("n")))
        .groupBy("host").agg(F.collect_list(F.struct("instance", importance.alias("importance"))).alias("low"))
    )


def extract(pages: DataFrame) -> DataFrame:
    """Rows of `pages` (page_id, url, html) as page_id, url, text, n_chars."""
    rows = pages.select("page_id", "url", "html", F.coalesce(F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1)), F.lit("")).alias("host"))
    rows = rows.join(low_branches(rows), "host", "left")

    def texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, lows in batches:
            yield pd.Series(["\n\n".join(text_blocks(Tree(p or "").root, () if low is None else [(r["instance"], r["importance"]) for r in low]))
                             for p, low in zip(pages, lows)], dtype=object)

    text = F.pandas_udf(texts, "string")("html", "low")
    return rows.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_site_style(pages: DataFrame) -> DataFrame:
    return extract(pages)
