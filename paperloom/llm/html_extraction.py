"""HTML extraction by tree scoring.

A page is parsed into a tree of elements; subtrees that can't be an article's text (scripts, menus, forms, blocks whose
tag, role, class or id says so) are left out; a block that only part of a longer class or id names stays where it holds
half of the page's paragraph points, a form where it holds nearly all, and classes don't count where they leave less than a
tenth. Each paragraph earns points for its length and commas, which go to all its ancestors: an element that holds nothing
but one other hands on the whole of its points, any other half of them, so a common container of paragraphs that are wrapped
one by one gets them undivided, and one sum from the leaves up is enough at any depth. An element's score is discounted by
the share of its text inside links. The best container is kept, or the article element around it, with those siblings that
score or read like text.

Defined cases: null, empty and markup-only pages give an empty text; unclosed and stray tags are repaired as browsers do
in the common cases; a button stays inside a paragraph only; text without any element is a page of one block; repeated rows get equal results; ties go to the
earlier element; pages of any length are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Element names of the HTML standard by how they are treated here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe xmp noembed noframes textarea title svg math".split())
DROPPED = RAW | set("head nav header footer aside button select dialog menu object canvas audio video map input fieldset".split())
BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = set("div section article main body".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = HEADING | set("p pre blockquote li dd dt td th figcaption div section article main body".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
# Roles, and words in class or id, of what isn't the article.
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
UNLIKELY = set("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments respond reply replies disqus cookie cookies consent gdpr notice notices alert share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager skip toolbar".split())
WHOLE_NAMES = {"article", "main"}
#: A block named by part of a longer name stays if it holds this share of the page's paragraph points; a page of which the class rule leaves less than LITTLE is read without it.
SHARE, LITTLE = 0.5, 0.1
#: A form stays if it holds this share of them: such pages stand in one form as a whole.
FORM_SHARE = 0.8
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?=[\s=>/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "named", "score", "length", "linked")

    def __init__(self, tag: str, parent: Node | None, drop: bool, named: str = ""):
        self.tag, self.parent, self.drop, self.named, self.children, self.score = tag, parent, drop, named, [], 0.0
        self.length = self.linked = 0


def unwanted(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def named(tag: str, attributes: str) -> str:
    """Whether class or id says that a block isn't the article: "whole" if a name does, "part" if a word in a longer one."""
    found = ""
    if not attributes or tag in ("html", "body"):
        return found
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            value = m[2] or m[3] or m[4] or ""
            if any(w.lower() in UNLIKELY for w in value.split()):
                return "whole"
            # an article may be a comment or an advert itself, but not because a part of a longer name says so
            if tag not in WHOLE_NAMES and any(w.lower() in UNLIKELY for w in WORDS.findall(value)):
                found = "part"
    return found


def parse(html: str) -> Node:
    root = Node("html", None, False)
    at, top, n = 0, root, len(html)
    opened: Counter[str] = Counter()  # elements by tag that were begun; an end tag with none left closes nothing
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            top.children.append(html[at:])
            break
        if lt > at:
            top.children.append(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(html, lt) or LOOSE.match(html, lt)
        if m is None:
            top.children.append("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if opened[tag] > 0:
                opened[tag] -= 1
                top = close(top, tag)
            continue
        if tag in ("svg", "math") and m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(html, at)
            at = n if end is None else html.find(">", end.start()) + 1 or n
            continue
        if tag in BLOCK:
            top = close_paragraph(top)
        if tag in CLOSES:
            top = close_items(top, tag)
        if tag in VOID:
            if tag in ("br", "hr", "wbr", "img"):
                top.children.append(" " if tag != "wbr" else "")
            continue
        if tag in ("html", "body") and top is root:
            continue
        gone = unwanted(tag, m[3]) and not (tag == "button" and top.tag == "p")
        node = Node(tag, top, top.drop or gone, "form" if tag == "form" else named(tag, m[3]))
        top.children.append(node)
        top = node
        opened[tag] += 1
    return root


def close(top: Node, tag: str) -> Node:
    node = top
    while node is not None and node.tag != tag:
        if tag not in BLOCK and node.tag in BLOCK and node.tag != "p":
            return top  # an inline end tag doesn't close blocks
        node = node.parent
    if node is None or node.parent is None:
        return top
    return node.parent


def close_paragraph(top: Node) -> Node:
    node = top
    while node is not None and (node.tag not in BLOCK or node.tag == "p"):
        if node.tag == "p":
            return node.parent
        node = node.parent
    return top


def close_items(top: Node, tag: str) -> Node:
    node, found = top, None
    while node is not None and node.tag not in SCOPES.get(tag, ()):
        if node.tag in CLOSES[tag]:
            found = node
        node = node.parent
    return found.parent if found is not None and found.parent is not None else top


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under a node, in page order, white space collapsed; left-out subtrees are skipped."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif not x.drop:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(x.children))
    end()
    return out


def measure(root: Node) -> list[Node]:
    """Set length and linked (characters of text, and of text in links) of all nodes; the nodes that count, in order."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        if not x.drop:
            order.append(x)
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node))
    for x in reversed(order):
        own = sum(len(c.strip()) for c in x.children if isinstance(c, str))
        x.length += own
        if x.tag == "a":
            x.linked = x.length
        if x.parent is not None:
            x.parent.length += x.length
            x.parent.linked += x.linked
    return order


def own_text(node: Node) -> str:
    """Text of a block outside the blocks in it."""
    out, stack = [], list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.drop and x.tag not in BLOCK:
            stack.extend(reversed(x.children))
    return " ".join("".join(out).split())


def link_density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def paragraph_points(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3)


def drop_named(root: Node) -> None:
    """Leave out the blocks that class or id names, by what they hold of the page's paragraph points."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        if not x.drop:
            order.append(x)
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node))
    if not any(x.named for x in order):
        return
    held: dict[int, float] = {}
    for x in reversed(order):
        text = own_text(x) if x.tag in PARAGRAPH else ""
        held[id(x)] = held.get(id(x), 0.0) + (paragraph_points(text) if text else 0.0)
        if x.parent is not None:
            held[id(x.parent)] = held.get(id(x.parent), 0.0) + held[id(x)]
    total, gone, stack, dropped = held[id(root)], 0.0, [root], []
    while stack:
        x = stack.pop()
        if x.drop:
            continue
        least = {"part": SHARE, "form": FORM_SHARE}.get(x.named, 0.0) * total
        if x.named == "whole" or held[id(x)] < least or x.named == "form" and not total:
            dropped.append(x)
            gone += held[id(x)]
        else:
            stack.extend(c for c in x.children if isinstance(c, Node))
    if total - gone >= LITTLE * total:
        for x in dropped:
            x.drop = True


def wraps(node: Node) -> bool:
    """Whether a node holds nothing but one other element with text."""
    if any(isinstance(c, str) and c.strip() for c in node.children):
        return False
    return sum(isinstance(c, Node) and not c.drop and c.length > 0 for c in node.children) == 1


def set_scores(order: list[Node]) -> None:
    """From the leaves up. A container's own text counts for itself, that of a paragraph for what it stands in."""
    for x in reversed(order):
        text = own_text(x) if x.tag in PARAGRAPH else ""
        points = paragraph_points(text) if text else 0.0
        if x.tag in ("p", "li", "td"):
            points *= 1 - min(link_density(x), 1)
        if x.tag in CONTAINER:
            x.score, points = x.score + points, 0.0
        if x.parent is not None:
            x.parent.score += points + (x.score if wraps(x) else x.score / 2)


def best_nodes(root: Node) -> list[Node]:
    order = measure(root)
    set_scores(order)
    if not any(x.score for x in order):
        return [root]
    value = lambda x: x.score * (1 - link_density(x)) * (1.5 if x.tag in ("article", "main") else 1)
    best = max(order, key=value)
    node = best
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    if node is not None:
        best = node
    if best.parent is None or best.tag == "main":
        return [best]
    least, kept = max(10.0, 0.2 * value(best)), []
    for x in best.parent.children:
        if not isinstance(x, Node) or x.drop:
            continue
        text = x is not best and x.tag == "p" and own_text(x)
        if x is best or value(x) >= least or x.tag in HEADING or text and (len(text) > 80 and link_density(x) < 0.25 or not x.linked and re.search(r"\.(\s|$)", text)):
            kept.append(x)
    return kept


def extract(html: str | None) -> str:
    """The main text of a page."""
    root = parse(html or "")
    drop_named(root)
    return " ".join(b for node in best_nodes(root) for b in blocks(node))


def main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in series:
            yield pages.map(extract)

    return pages.withColumn(out, run(F.coalesce(F.col(html), F.lit(""))))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
