"""Tables of one HTML text, resolved by a stack over its tags in one pass; ``operators.html_tables`` has them as columns.

A text's own control characters are text like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

TAG = r"(?i)</?(?:table|tr|t[dh])(?=[\s/>])[^>]*>"
# How a table inside a cell is written, and the depth of nesting from which only its size is.
CELL_SEPARATOR, ROW_SEPARATOR, TOO_DEEP, NESTING = " · ", "<br>", " 깊이 초과 생략", 5
#: Spans beyond these are taken as these, as browsers do.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

LEFT, UP = "←", "↑"

#: A cell's own text in pieces, the tables in it and its tag.
Cell = tuple[list[str], list[str], str]
#: Rows of (text, col_span, row_span).
Rows = list[list[tuple[str, int, int]]]

TAGS = re.compile(r"(</?[tT](?:[aA][bB][lL][eE]|[rRdDhH])(?=[ \t\n\r\f\v/>])[^>]*>)")  # TAG, in a form that is found faster
SPANS = [(re.compile(rf"(?ai)\s{name}\s*=\s*[\"']?\s*(\d{{1,9}})"), most) for name, most in (("colspan", MOST_COLUMNS), ("rowspan", MOST_ROWS))]
WHITE = " \t\n\r\f\v"
ODD, SPACES = re.compile(r"(?a)[\s<&]"), re.compile(r"(?a)[^\S ]\s*| \s+")  # a single space stays
#: Own markup and what stands for it, in this order.
MARKUP = [
    (re.compile(r"(?ai)</(?:p|div|h[1-6]|ul|ol|li|blockquote|pre)\s*>|<br\s*/?>"), "\n"),
    (re.compile(r"(?ai)</?(?:strong|b)(?:\s[^>]*)?>"), "**"),
    (re.compile(r"(?ai)</?(?:em|i)(?:\s[^>]*)?>"), "*"),
    (re.compile(r"</?[a-zA-Z][^>]*>"), ""),
]
UNIT, OVERLAP = re.compile(r"<[^>]*>"), re.compile(r"<[^>]*<")
OUTER_BREAKS = re.compile(r"^(?:<br>)+|(?:<br>)+\Z")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescaped(x: str) -> str:
    if "&" in x:
        for a, b in ENTITIES:
            x = x.replace(a, b)
    return x


def without_markup(x: str) -> str:
    for pattern, put in MARKUP:
        x = pattern.sub(put, x)
    return x


@lru_cache(4096)
def unit(tag: str) -> str:
    return without_markup(tag)


def inline(html: str) -> str:
    """A cell's own markup on one line: blocks and breaks as <br>, emphasis as Markdown, other tags gone, entities read."""
    if html.isalnum() or not ODD.search(html):
        return html
    x = SPACES.sub(" ", html).strip(" ")
    if "<" not in x:
        return unescaped(x)
    # tags in none of which another begins are each replaced alone
    x = unescaped(without_markup(x) if OVERLAP.search(x) else UNIT.sub(lambda m: unit(m[0]), x))
    return "<br>".join([part for line in x.split("\n") if (part := line.strip(WHITE))]) if "\n" in x else x.strip(WHITE)


def cell_line(cell: Cell) -> str:
    """A cell's own text and the tables in it, in order, without what is empty."""
    own, nested, _ = cell
    line = inline(own[0] if len(own) == 1 else "".join(own))
    return ROW_SEPARATOR.join([x for x in (line, *nested) if x]) if nested else line


def flattened(rows: list[list[Cell]], depth: int) -> str:
    """A table in a cell as text: its size, then its rows."""
    size = f"(표 {len(rows)}×{len(rows[0]) if rows else 0})"
    if depth >= NESTING:
        return size + TOO_DEEP
    return ROW_SEPARATOR.join([size, *[CELL_SEPARATOR.join([cell_line(cell) for cell in row]) for row in rows]])


@lru_cache(4096)
def spans(tag: str) -> tuple[int, int]:
    found = [(pattern.search(tag), most) for pattern, most in SPANS]
    columns, rows = (max(1, min(most, int(m[1]))) if m else 1 for m, most in found)
    return columns, rows


class Kinds(dict):
    """What a tag is, by its first four characters."""

    def __missing__(self, begin: str) -> int:
        kind = begin.lower()
        self[begin] = END_OF_TABLE if kind == "</ta" else END if kind[1] == "/" else TABLE if kind == "<tab" else ROW if kind[2] == "r" else CELL
        return self[begin]


CELL, END, ROW, TABLE, END_OF_TABLE = range(5)
KINDS = Kinds()


def outermost(pieces: list[str]) -> Iterator[tuple[int, int, Rows]]:
    """Begin, end and rows of each outermost table that is closed; pieces are texts and, between them, tags."""
    stack: list[tuple[list[list[Cell]], Cell | None]] = []  # tables around, each with its open cell
    rows: list[list[Cell]] | None = None
    cell, begin, kinds = None, 0, KINDS
    for i, (tag, behind) in enumerate(zip(pieces[1::2], pieces[2::2], strict=True)):
        kind = kinds[tag[:4]]
        if rows is None:
            if kind == TABLE:
                begin, rows = 2 * i + 1, []
            continue
        if kind == CELL:
            cell = ([behind], [], tag)
            if rows:
                rows[-1].append(cell)
            else:
                rows.append([cell])
        elif kind == END:
            cell = None
        elif kind == ROW:
            cell = None
            rows.append([])
        elif kind == TABLE:
            stack.append((rows, cell))
            rows, cell = [], None
        elif stack:
            inside, depth = rows, len(stack) - 1
            rows, cell = stack.pop()
            if cell is not None:
                cell[0].append(behind)
                if depth <= NESTING:
                    cell[1].append(flattened(inside, depth))
        else:
            yield begin, 2 * i + 1, [[(cell_line(cell), *spans(cell[2])) for cell in row] for row in rows]
            rows = cell = None


def tables(text: str | None) -> list[Rows]:
    """Outermost tables that are closed; those without cells too."""
    return [rows for _, _, rows in outermost(TAGS.split(text or ""))]


def rectangle(rows: Rows) -> list[list[str]]:
    """Rows of texts of one width: what a cell spans shows an arrow, and rows that are too short end with blanks.

    A cell goes to the first column that none above covers. Columns of a row-spanning cell are covered anew, whatever they were.
    """
    left: dict[int, int] = {}  # how many more rows a column is covered for
    lines = []

    def drained(line: list[str]) -> None:
        while left.get(len(line), 0) > 0:
            left[len(line)] -= 1
            line.append(UP)

    for row in rows:
        line: list[str] = []
        for text, columns, height in row:
            if left:
                drained(line)
            if height > 1:
                left.update(dict.fromkeys(range(len(line), len(line) + columns), height - 1))
            line.append(text)
            if columns > 1:
                line.extend([LEFT] * (columns - 1))
        if left:
            drained(line)
        lines.append(line)
    width = max(map(len, lines), default=0)
    return [line if len(line) == width else line + [""] * (width - len(line)) for line in lines]


def pipe_table(lines: list[list[str]]) -> str | None:
    """Rows of texts, of one width and each on one line, as a pipe table; null if there are no cells."""
    if not lines or not lines[0]:
        return None
    written = [f"| {' | '.join([pipe_cell(x) for x in line])} |" for line in lines]
    return "\n".join([written[0], f"| {' | '.join(['---'] * len(lines[0]))} |", *written[1:]])


def pipe_cell(text: str) -> str:
    if text.isalnum():
        return text
    x = text.strip(" ")
    x = OUTER_BREAKS.sub("", x) if x.startswith("<br>") or x.endswith("<br>") else x
    return x.replace("|", "\\|")


def rectangles(text: str | None) -> list[list[list[str]]]:
    return [rectangle(rows) for rows in tables(text)]


def normalized(text: str | None) -> str | None:
    """A text with each outermost table as a pipe table; one without cells, and all else, stays as it is."""
    if text is None:
        return None
    pieces, out, at = TAGS.split(text), [], 0
    for begin, end, rows in outermost(pieces):
        made = pipe_table(rectangle(rows))
        if made is not None:
            out += [*pieces[at:begin], made]
            at = end + 1
    return "".join([*out, *pieces[at:]]) if at else text
