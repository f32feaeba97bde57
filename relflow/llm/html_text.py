"""Main text of web pages by tree scoring.

A page becomes a tree (open tags are closed where HTML implies it).  Text is gathered into
blocks; boilerplate subtrees (navigation, headers, footers, asides, forms, scripts, styles, and
elements whose role or a whole class or id name says advert, menu, comments and the like) are left
out; one marked by such a name or role only, or a form, stays where it holds the article (or main)
element, or without one most of the page's text outside links.
Every paragraph-like block passes points for its length and commas to its parent and half of
them to its grandparent, then each container's points shrink by its link density.  The best
container is kept with those siblings, its own and those of every container around it, that score
near it or hold few links; bare text beside them stays likewise.
An <article> (or main) element that holds most of the points is taken as the container.

Pages are scanned once, left to right; what a subtree holds is a range of the blocks, so its sums are
differences of running sums.  The time is linear in the page whatever its markup.

Defined results: null and empty pages give an empty text; pages are judged one by one, so
repeated rows repeat their result; an empty table gives none; other columns never enter.
Malformed markup never fails: unknown end tags are ignored and open elements close at the end.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_of

#: Possessive throughout, so that each character is looked at a bounded number of times.
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTR = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_GAP = re.compile(r"[\s/]*+")
#: Elements deeper than this become siblings of the deepest open one, as in browsers; walks to ancestors are bounded by it.
MAX_DEPTH = 512
_RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "svg", "title"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_DROP = set("head nav header footer aside form button select option label fieldset dialog menu object canvas audio video map annotation annotation-xml".split()) | _RAW
_BLOCK = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote div section article main body caption figure figcaption summary details address center tr table ul ol dl tbody thead tfoot hr html root".split())
#: What an element closes implicitly when it opens.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOP = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": {"td", "th", "button", "object"}}
_ENDS_P = _BLOCK | set("form nav header footer aside fieldset figure".split())
#: Whole class or id names (lower case, _ as -) that mean boilerplate wherever they stand.
_BAD = set(
    "ad ads advert adverts advertisement advertisements adsense ad-slot ad-unit ad-banner ad-box ad-container ad-wrapper google-ad google-ads byline-ad sponsored sponsor promo promos banner site-banner cookie-banner "
    "menu main-menu site-menu nav-menu nav navbar nav-bar navigation main-nav site-nav breadcrumb breadcrumbs sidebar side-bar left-sidebar right-sidebar footer site-footer page-footer site-header masthead "
    "cookie-notice cookie-consent cookies-notice gdpr popup modal newsletter newsletter-signup subscribe signup login share sharing share-buttons share-bar social social-share social-links social-media "
    "related related-posts related-articles related-links related-stories recommended recommendations comments comment-list commentlist comment-section comments-section comments-area reader-comments user-comments disqus disqus-thread respond "
    "pagination pager toolbar skip skip-link hidden copyright outbrain taboola".split()
)
_BAD_ROLE = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: What stays beside the best container if it holds few links.
_BESIDE = set("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table div section article figure details address center".split())
_KEEP = {"html", "body", "article", "main", "root"}


class Node:
    __slots__ = ("tag", "parent", "depth", "items", "bad", "points", "lo", "hi", "chars", "linked")

    def __init__(self, tag, parent, bad=0):
        self.tag, self.parent, self.bad = tag, parent, bad
        self.depth = 0 if parent is None else parent.depth + 1
        self.items = []
        self.points = self.lo = self.hi = self.chars = self.linked = 0


def _is_bad(tag: str, attrs: list[tuple[str, str]]) -> int:
    """0 for content, 2 for boilerplate, 1 for what a name, a role or a form alone makes boilerplate."""
    if tag in _DROP:
        return 1 if tag == "form" else 2
    if tag in _KEEP:
        return 0
    bad = 0
    for name, value in attrs:
        if name in ("class", "id"):
            if not _BAD.isdisjoint(value.lower().replace("_", "-").split()):
                bad = 1
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 2
        elif name == "role" and value.lower() in _BAD_ROLE:
            bad = 1
        elif name == "style" and re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", value, re.I):
            return 2
    return bad


def _spare(root: Node) -> None:
    """Take the mark off weakly marked subtrees that hold the article, or without one most of the unlinked text."""
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        order.append((node, link))
        stack += [(x, link or x.tag == "a") for x in node.items if isinstance(x, Node) and x.bad < 2]
    if not any(node.bad for node, _ in order):
        return
    held, marked = {}, {}
    for node, link in reversed(order):  # children before parents
        below = [x for x in node.items if isinstance(x, Node) and x.bad < 2]
        held[id(node)] = sum(held[id(x)] for x in below) + (0 if link else sum(len(x.strip()) for x in node.items if isinstance(x, str)))
        marked[id(node)] = node.tag in ("article", "main") or any(marked[id(x)] for x in below)
    for node, _ in order:
        if node.bad == 1 and (marked[id(node)] or not marked[id(root)] and 2 * held[id(node)] > held[id(root)]):
            node.bad = 0


class _Tree:
    """The open elements of a page that is being read."""

    def __init__(self):
        self.root = self.now = Node("root", None)
        self.open: Counter = Counter()

    def push(self, node: Node) -> None:
        self.open[node.tag] += 1
        self.now = node

    def pop_to(self, node: Node) -> None:
        while self.now is not node:
            self.open[self.now.tag] -= 1
            self.now = self.now.parent

    def end(self, tag: str) -> None:
        if self.open[tag]:
            up = self.now
            while up.tag != tag:
                up = up.parent
            self.pop_to(up.parent)

    def imply_end(self, tags: set, stop: set) -> None:
        """Close the nearest of ``tags`` that is open inside the nearest of ``stop``."""
        if any(self.open[t] for t in tags):
            up = self.now
            while up is not self.root and up.tag not in stop:
                if up.tag in tags:
                    return self.pop_to(up.parent)
                up = up.parent

    def start(self, tag: str, attrs: list[tuple[str, str]]) -> bool:
        """Add an element; whether it is open now."""
        if tag in _ENDS_P:
            self.imply_end({"p"}, _STOP["p"])
        if tag in _CLOSES:
            self.imply_end(_CLOSES[tag], _STOP[tag])
        if self.now.depth >= MAX_DEPTH:
            self.pop_to(self.now.parent)
        node = Node(tag, self.now, _is_bad(tag, attrs))
        self.now.items.append(node)
        if tag in _VOID or tag in _RAW:
            return False
        self.push(node)
        return True


def _start_tag(page: str, at: int) -> tuple[str, list[tuple[str, str]], bool, int] | None:
    """Name, attributes, whether it closes itself, and the place behind the tag at ``at``; None if it never ends."""
    m = _NAME.match(page, at + 1)
    name, at, attrs = m[0].lower(), m.end(), []
    while m := _ATTR.match(page, at):
        attrs.append((m[1].lower(), m[2] or m[3] or m[4] or ""))
        at = m.end()
    at = _GAP.match(page, at).end()
    return (name, attrs, page[at - 1] == "/", at + 1) if at < len(page) else None


def parse(page: str) -> Node:
    tree = _Tree()
    at, end = 0, len(page)
    while at < end:
        tag = page.find("<", at)
        if tag != at:
            tree.now.items.append(page[at : tag if tag >= 0 else end])
            if tag < 0:
                break
        after = page[tag + 1 : tag + 2]
        if after in ("!", "?") or after == "/" and not _NAME.match(page, tag + 2):
            comment = page.startswith("<!--", tag)
            at = page.find("-->" if comment else ">", tag + 2)
            if at < 0:
                break
            at += 3 if comment else 1
        elif after == "/":
            at = page.find(">", tag) + 1
            if not at:
                break
            tree.end(_NAME.match(page, tag + 2)[0].lower())
        elif _NAME.match(page, tag + 1):
            got = _start_tag(page, tag)
            if got is None:  # a tag that never ends: the rest is markup
                break
            name, attrs, closed, at = got
            if not tree.start(name, attrs):
                if name in _RAW and not closed:  # its content is not markup
                    at = _after(page, name, at)
            elif closed and name in ("math", "path"):
                tree.end(name)
        else:
            tree.now.items.append("<")
            at = tag + 1
    _spare(tree.root)
    return tree.root


_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in _RAW}


def _after(page: str, raw: str, at: int) -> int:
    got = _END[raw].search(page, at)
    return got.end() if got else len(page)


def _blocks(root: Node) -> list[tuple[str, Node, int]]:
    """(text, owner, linked characters) of each block outside boilerplate, in page order; sets nodes' ranges (lo, hi)."""
    out, parts, linked = [], [], 0
    owners = [root]

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, owners[-1], min(linked, len(text))))
            parts.clear()
        linked = 0

    stack = [(root, 0, False)]  # explicit stack: depth is the page's, not Python's
    while stack:
        node, i, link = stack.pop()
        if i == 0:
            if node.tag in _BLOCK:
                flush()
                owners.append(node)
            node.lo = len(out)
        if i < len(node.items):
            stack.append((node, i + 1, link))
            item = node.items[i]
            if isinstance(item, str):
                parts.append(item)
                if link:
                    linked += len(item)
            elif item.tag == "br":
                parts.append(" ")
            elif not item.bad:
                stack.append((item, 0, link or item.tag == "a"))
            elif item.tag in _BLOCK or item.tag in _ENDS_P:
                flush()
            else:
                parts.append(" " if item.tag not in _RAW else "")
        else:
            if node.tag in _BLOCK:
                flush()
                owners.pop()
            node.hi = len(out)
    return out


def points_of(text: str) -> float:
    """What a block passes on: its length and commas."""
    return 1 + min(len(text) / 100, 3) + text.count(",") - 0.5 * (len(text) < 25)


def _containers(root: Node) -> list[Node]:
    """All elements that hold a block, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.hi > node.lo:
            out.append(node)
            stack += [x for x in reversed(node.items) if isinstance(x, Node) and not x.bad]
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    blocks = _blocks(root)
    if not blocks:
        return ""
    chars, links = [0], [0]
    for text, owner, linked in blocks:
        chars.append(chars[-1] + len(text))
        links.append(links[-1] + linked)
        holder = owner.parent if owner.parent is not None and owner.tag not in ("div", "section", "article", "main", "body", "root") else owner
        points = points_of(text)
        holder.points += points
        if holder.parent is not None:
            holder.parent.points += points / 2
    scored = _containers(root)
    for node in scored:
        node.chars, node.linked = chars[node.hi] - chars[node.lo], links[node.hi] - links[node.lo]
        node.points *= 1 - node.linked / max(node.chars, 1)
    best = max(scored, key=lambda x: (x.points, x.lo - x.hi))
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:  # the page's own mark for its content, when the best container is in or around it
        best = up
    else:
        marked = [x for x in scored if x.tag in ("article", "main") and 2 * x.chars >= root.chars]
        if marked:
            best = max(marked, key=lambda x: x.chars)
    keep = [best.lo <= n < best.hi for n in range(len(blocks))]
    around, at = set(), best
    while at.parent is not None and at.tag not in ("article", "main", "body"):
        for item in at.parent.items:
            if isinstance(item, Node) and item is not at and not item.bad and item.hi > item.lo:
                if item.points >= max(10, best.points * 0.2) or item.tag in _BESIDE and item.linked < 0.25 * item.chars:
                    keep[item.lo : item.hi] = [True] * (item.hi - item.lo)
        at = at.parent
        around.add(id(at))
    for n, (_, owner, linked) in enumerate(blocks):  # bare text of the containers around
        if id(owner) in around and linked == 0:
            keep[n] = True
    return "\n\n".join(text for (text, _, _), stays in zip(blocks, keep, strict=True) if stays)


def extract(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """The frame with ``out`` (main text) and ``n_chars`` instead of ``page``."""
    rest = [f for f in pages.schema.fields if f.name not in (page, out, "n_chars")]
    fields = [*rest, T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())]
    names = [f"c{i}" for i in range(len(fields))]  # whatever the frame's own columns are called
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)])

    def run(batches):
        from relflow.llm.html_text import main_text as of

        for batch in batches:
            texts = [of(x.as_py()) for x in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)

    rows = pages.select(*[F.col(f"`{f.name}`").alias(n) for n, f in zip(names, rest, strict=False)], text_of(page).alias("page"))
    return rows.mapInArrow(run, schema).toDF(*[f.name for f in fields])


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
