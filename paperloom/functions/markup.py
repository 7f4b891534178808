"""HTML trees in pure Python: parse, clean, pick the content, serialise to Markdown with merged cells as arrows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

# Element names of the HTML standard by how they are treated here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSAFE = set("script noscript style template iframe object embed link meta canvas svg".split())
BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
LAZY = ("data-lazy-src", "data-src", "data-original")
HINTS = (lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("id") == "content")
_ITEMS, _CELLS, _ROWS, _TERMS = (("li",), ("ul", "ol")), (("td", "th"), ("tr", "table")), (("tr",), ("table",)), (("dt", "dd"), ("dl",))
ENDED = {"li": (_ITEMS,), "td": (_CELLS,), "th": (_CELLS,), "tr": (_CELLS, _ROWS), "dt": (_TERMS,), "dd": (_TERMS,)}  # what a start tag ends, up to where
LEFT, UP, MAX_DEPTH, ENOUGH = "←", "↑", 5, 80


@dataclass
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)

    def walk(self):
        yield self
        for c in self.children:
            if isinstance(c, Element):
                yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else "" if c.tag in ("script", "style") else c.text() for c in self.children)

    def first(self, tag: str) -> Element | None:
        return next((n for n in self.walk() if n.tag == tag), None)


class Builder(HTMLParser):
    """Tree of a page; a paragraph ends where a block begins, items end where the next begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root")
        self.stack = [self.root]

    def updatepos(self, i, j):
        """Lines and columns aren't asked for."""
        return j

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and any(n.tag == "p" for n in self.stack):
            self.handle_endtag("p")
        for group, scope in ENDED.get(tag, ()):
            self.end_within(group, scope)
        node = Element(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID and len(self.stack) < 400:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(Element(tag, {k: v or "" for k, v in attrs}))

    def end_within(self, group, scope):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in group:
                del self.stack[k:]
                return
            if self.stack[k].tag in scope:
                return

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str) -> Element:
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def dangerous(uri: str) -> bool:
    x = re.sub(r"[\x00-\x20]", "", uri).lower()
    return x.startswith(("javascript:", "vbscript:")) or x.startswith("data:") and not x.startswith("data:image/")


def sanitize(node: Element, base: str | None = None) -> Element:
    """Without active elements, handlers and dangerous addresses; lazy images load; addresses are made absolute."""
    kept = [c if isinstance(c, str) else sanitize(c, base) for c in node.children if isinstance(c, str) or c.tag not in UNSAFE]
    if not node.attrs:
        return Element(node.tag, {}, kept)
    attrs = {k: v for k, v in node.attrs.items() if not k.lower().startswith("on")}
    if node.tag == "img":
        lazy = next((attrs[k] for k in LAZY if attrs.get(k, "").strip()), None)
        if lazy:
            attrs["src"] = lazy
        attrs = {k: v for k, v in attrs.items() if k not in LAZY}
    for k in ("href", "src", "action", "formaction", "poster"):
        if k in attrs and dangerous(attrs[k]):
            del attrs[k]
    key = {"img": "src", "source": "src", "a": "href"}.get(node.tag)
    if base and key in attrs and not re.match(r"(?i)[a-z][a-z0-9+.-]*:|#", attrs[key]):
        try:
            attrs[key] = urljoin(base, attrs[key])
        except ValueError:
            pass
    return Element(node.tag, attrs, kept)


def content(root: Element) -> tuple[Element, str | None]:
    """(content, title): a hinted element with enough text, else the densest container, else the body."""
    found = root.first("title")
    title = " ".join(found.text().split()) if found else None
    for hint in HINTS:
        node = next((n for n in root.walk() if hint(n)), None)
        if node and len(node.text().strip()) >= ENOUGH:
            return node, title or None
    body = root.first("body") or root
    return densest(body) or body, title or None


def densest(body: Element) -> Element | None:
    """The container whose own paragraphs hold most text outside links."""
    best, most = None, ENOUGH - 1
    for n in body.walk():
        if n.tag in ("div", "section", "td", "body", "article"):
            size = sum(len(p.text().strip()) - sum(len(a.text()) for a in p.walk() if a.tag == "a") for p in n.children if isinstance(p, Element) and p.tag in ("p", "pre", "blockquote"))
            if size > most:
                best, most = n, size
    return best


def to_html(node: Element | str) -> str:
    if isinstance(node, str):
        return escape(node, quote=False)
    inner = "".join(map(to_html, node.children))
    if node.tag == "#root":
        return inner
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}>" + ("" if node.tag in VOID else f"{inner}</{node.tag}>")


def own_rows(table: Element) -> list[Element]:
    """Rows of a table in order, those of its sections included, without those of tables inside it."""
    out = []
    for c in table.children:
        if isinstance(c, Element):
            if c.tag == "tr":
                out.append(c)
            elif c.tag in ("thead", "tbody", "tfoot"):
                out += own_rows(c)
    return out


def span(cell: Element, name: str, most: int) -> int:
    value = cell.attrs.get(name, "1").strip()
    return min(max(int(value), 1), most) if value.isdigit() else 1


def expand(table: Element, depth: int = 0) -> list[list[str]]:
    """A rectangle of cell texts: arrows where a merged cell continues, blanks where a row is short."""
    rows = own_rows(table)
    grid: dict[tuple[int, int], str] = {}
    for r, tr in enumerate(rows):
        c = 0
        for cell in (x for x in tr.children if isinstance(x, Element) and x.tag in ("td", "th")):
            while (r, c) in grid:
                c += 1
            height, width = span(cell, "rowspan", len(rows) - r), span(cell, "colspan", 200)
            for i in range(height):
                for j in range(width):
                    grid.setdefault((r + i, c + j), UP if i else LEFT if j else cell_text(cell, depth))
            c += width
    width = max((c for _, c in grid), default=-1) + 1
    return [[grid.get((r, c), "") for c in range(width)] for r in range(len(rows))]


def cell_text(cell: Element, depth: int) -> str:
    text = inline(cell, depth, in_cell=True)
    text = re.sub(r"\s*(?:<br>\s*)+", "<br>", re.sub(r"[^\S\n]*\n\s*", "<br>", text.strip()))
    return re.sub(r"^(?:<br>)+|(?:<br>)+$", "", text).replace("|", "\\|")


def nested(table: Element, depth: int) -> str:
    """A table inside a cell, flattened: its size and a line for each row."""
    if depth >= MAX_DEPTH:
        return " ".join(table.text().split())
    grid = expand(table, depth + 1)
    lines = [" · ".join(x.replace("\\|", "|") for x in row if x not in ("", LEFT, UP)) for row in grid]
    return f"(표 {len(grid)}×{len(grid[0]) if grid else 0})<br>" + "<br>".join(x for x in lines if x)


def pipe_table(grid: list[list[str]]) -> str:
    if not grid or not grid[0]:
        return ""
    line = lambda row: "| " + " | ".join(row) + " |"
    return "\n".join([line(grid[0]), line(["---"] * len(grid[0])), *map(line, grid[1:])])


def inline(node: Element, depth: int = 0, in_cell: bool = False) -> str:
    """Text with emphasis, code, links and images; blocks in it are set apart by breaks."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
            continue
        inner = lambda n=c: inline(n, depth, in_cell)
        if c.tag == "br":
            out.append("<br>" if in_cell else "  \n")
        elif c.tag in ("strong", "b"):
            out.append(mark(inner(), "**"))
        elif c.tag in ("em", "i"):
            out.append(mark(inner(), "*"))
        elif c.tag in ("del", "s", "strike"):
            out.append(mark(inner(), "~~"))
        elif c.tag == "code":
            text = c.text()
            out.append(f"``{text}``" if "`" in text else f"`{text}`" if text.strip() else text)
        elif c.tag == "a":
            text, href = inner(), c.attrs.get("href", "")
            out.append(f"[{text.strip()}]({href})" if href and text.strip() else text)
        elif c.tag == "img":
            if c.attrs.get("src"):
                out.append(f"![{c.attrs.get('alt', '')}]({c.attrs['src']})")
        elif c.tag == "table":
            out.append("<br>" + nested(c, depth) + "<br>" if in_cell else "\n\n" + pipe_table(expand(c)) + "\n\n")
        elif c.tag in UNSAFE or c.tag == "title":
            continue
        elif c.tag in BLOCK:
            sep = "<br>" if in_cell else "\n"
            out.append(sep + inner() + sep)
        else:
            out.append(inner())
    return "".join(out)


def mark(text: str, sign: str) -> str:
    """Emphasis with its white space outside."""
    body = text.strip()
    if not body:
        return text
    lead, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    return f"{lead}{sign}{body}{sign}{tail}"


def blocks(node: Element, keep_tables: bool = False) -> list[str]:
    """Markdown blocks of a container. Tables become pipe tables, or stay HTML."""
    out: list[str] = []
    loose: list[Element | str] = []

    def flush() -> None:
        text = re.sub(r"[^\S\n]*\n(?!\n)", "\n", inline(Element("span", {}, list(loose)))).strip()
        loose.clear()
        if text:
            out.append(text)

    for c in node.children:
        if isinstance(c, str) or c.tag not in BLOCK:
            if isinstance(c, str) or c.tag not in UNSAFE and c.tag not in ("title", "head"):
                loose.append(c)
            continue
        flush()
        if c.tag == "hr":
            out.append("---")
        elif re.fullmatch("h[1-6]", c.tag):
            text = " ".join(inline(c).split())
            if text:
                out.append("#" * int(c.tag[1]) + " " + text)
        elif c.tag == "p":
            out += blocks(Element("div", {}, c.children), keep_tables)
        elif c.tag == "pre":
            code = c.first("code")
            language = re.search(r"language-([\w+-]+)", (code or c).attrs.get("class", ""))
            out.append(f"```{language[1] if language else ''}\n" + c.text().strip("\n") + "\n```")
        elif c.tag == "blockquote":
            inner = "\n\n".join(blocks(c, keep_tables))
            if inner:
                out.append("\n".join(f"> {x}".rstrip() for x in inner.split("\n")))
        elif c.tag in ("ul", "ol"):
            items = []
            for k, li in enumerate(x for x in c.children if isinstance(x, Element) and x.tag == "li"):
                sign = f"{k + 1}." if c.tag == "ol" else "-"
                body = "\n".join(blocks(li, keep_tables))
                items.append(f"{sign} " + body.replace("\n", "\n" + " " * (len(sign) + 1)))
            if items:
                out.append("\n".join(items))
        elif c.tag == "table":
            made = to_html(c) if keep_tables else pipe_table(expand(c))
            if made:
                out.append(made)
        else:
            out += blocks(c, keep_tables)
    flush()
    return out


def to_markdown(node: Element, keep_tables: bool = False) -> str:
    return "\n\n".join(blocks(node, keep_tables)).replace("\u200b", "")


def page_to_markdown(html: str, url: str | None) -> str:
    """decode > extract > sanitise > resolve > strip zero width > title > serialise."""
    found, title = content(parse(html))
    clean = sanitize(found, url)
    if title and clean.first("h1") is None:
        clean = Element("div", {}, [Element("h1", {}, [title]), clean])
    return re.sub("[\u200b\u200c\u200d\ufeff]", "", "\n\n".join(blocks(Element("#root", {}, [clean]))))
