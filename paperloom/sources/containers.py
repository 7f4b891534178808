"""Office documents as a source: XLSX, XLS, DOCX and HWPX read from bytes, on executors, with the standard library.

Spreadsheets come out as long-form cells for ``operators.grid``; text documents as HTML for ``functions.markup``. A file
that can't be read is a row with an error, never a failed batch.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator
from html import escape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.cellformat import BUILTIN, ERRORS
from ..functions.text import STRIKE_SHAPES

CELLS = "path string, sheet int, sheet_name string, sheet_hidden boolean, row int, col int, raw string, text string, format_id int, format_code string, date1904 boolean, row_hidden boolean, col_hidden boolean, href string, error string"
MERGES = "path string, sheet int, r1 int, c1 int, r2 int, c2 int"
#: Bytes that a member of an archive may have when unpacked.
MAX_MEMBER = 1 << 28
#: Rows that a reader gives out together, and bytes of texts beyond which it doesn't wait for more.
ROWS_OUT, BYTES_OUT = 2048, 1 << 22


def files(spark: SparkSession, path: str, patterns: str = "*") -> DataFrame:
    """Files below a folder, without dot names: path, length, content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", patterns).load(path)
    return found.where(~F.col("path").rlike(r"/\.[^/]*(/|\z)")).select("path", "length", "content")


class Archive:
    """Members of a ZIP by normalised name."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = {normal(x): x for x in self.zip.namelist()}

    def read(self, name: str) -> bytes | None:
        real = self.names.get(normal(name))
        if real is None:
            return None
        if self.zip.getinfo(real).file_size > MAX_MEMBER:
            raise ValueError("member too large")
        return self.zip.read(real)

    def xml(self, name: str) -> ElementTree.Element | None:
        raw = self.read(name)
        return None if raw is None else ElementTree.fromstring(raw)


def normal(name: str) -> str:
    return posixpath.normpath("/" + name.replace("\\", "/")).lstrip("/")


def local(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def find(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if local(x) == name)


def attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


def relations(archive: Archive, part: str) -> dict[str, str]:
    """Targets of a part's relationships, as member names (or addresses, where external)."""
    folder, base = posixpath.split(part)
    root = archive.xml(f"{folder}/_rels/{base}.rels")
    out = {}
    for r in find(root, "Relationship") if root is not None else ():
        target = r.get("Target", "")
        external = r.get("TargetMode") == "External"
        out[r.get("Id", "")] = target if external else normal(target if target.startswith("/") else posixpath.join(folder, target))
    return out


def a1(reference: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", reference or "")
    if not m:
        return None
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def rich_text(node: ElementTree.Element) -> str:
    """Text of a string item: its runs, without phonetic hints."""
    out = []
    for c in node:
        if local(c) == "t":
            out.append(c.text or "")
        elif local(c) == "r":
            out += [t.text or "" for t in c if local(t) == "t"]
    return "".join(out)


def xlsx(content: bytes) -> tuple[list[dict], list[dict]]:
    """(cells, merges) of a workbook."""
    archive = Archive(content)
    book = archive.xml("xl/workbook.xml")
    if book is None:
        raise ValueError("no workbook")
    targets = relations(archive, "xl/workbook.xml")
    date1904 = any((x.get("date1904") or "") in ("1", "true") for x in find(book, "workbookPr"))
    shared_root = archive.xml("xl/sharedStrings.xml")
    shared = [rich_text(x) for x in find(shared_root, "si")] if shared_root is not None else []
    formats, styles = {}, []
    style_root = archive.xml("xl/styles.xml")
    if style_root is not None:
        formats = {int(x.get("numFmtId", "0")): x.get("formatCode", "") for x in find(style_root, "numFmt")}
        styles = [int(x.get("numFmtId", "0")) for xfs in find(style_root, "cellXfs") for x in xfs if local(x) == "xf"]
    cells, merges = [], []
    sheets = list(find(book, "sheet"))
    if not sheets:
        raise ValueError("no sheets")
    for k, s in enumerate(sheets):
        part = targets.get(attribute(s, "id") or "", "")
        root = archive.xml(part) if part else None
        head = {"sheet": k, "sheet_name": s.get("name", ""), "sheet_hidden": s.get("state", "visible") != "visible", "date1904": date1904}
        if root is None:
            cells.append(head | {"error": "missing-sheet"})
            continue
        links = relations(archive, part)
        hrefs = {x.get("ref"): links.get(attribute(x, "id") or "") for x in find(root, "hyperlink")}
        hidden = {c for x in find(root, "col") if x.get("hidden") in ("1", "true") for c in range(int(x.get("min", "1")) - 1, min(int(x.get("max", "1")), 16384))}
        for x in find(root, "mergeCell"):
            ends = [a1(y) for y in (x.get("ref") or "").split(":")]
            if len(ends) == 2 and all(ends):
                merges.append({"sheet": k, "r1": ends[0][0], "c1": ends[0][1], "r2": ends[1][0], "c2": ends[1][1]})
        row = -1
        for r in find(root, "row"):
            row = int(r.get("r")) - 1 if (r.get("r") or "").isdigit() else row + 1
            col = -1
            for c in r:
                if local(c) != "c":
                    continue
                at = a1(c.get("r", ""))
                col = at[1] if at else col + 1
                raw, plain = cell_value(c, shared)
                style = int(c.get("s", "0"))
                format_id = styles[style] if style < len(styles) else 0
                code = None if plain else formats.get(format_id, BUILTIN.get(format_id))
                cells.append(head | {"row": row, "col": col, "raw": raw, "format_id": format_id, "format_code": code, "row_hidden": r.get("hidden") in ("1", "true"), "col_hidden": col in hidden, "href": hrefs.get(c.get("r"))})
    return cells, merges


def cell_value(cell: ElementTree.Element, shared: list[str]) -> tuple[str, bool]:
    """(text, whether it's text rather than a number that a format renders)."""
    kind = cell.get("t", "n")
    value = next((x.text or "" for x in cell if local(x) == "v"), None)
    if kind == "s":
        k = int(value) if (value or "").isdigit() else -1
        return (shared[k] if 0 <= k < len(shared) else ""), True
    if kind == "inlineStr":
        return "".join(rich_text(x) for x in cell if local(x) == "is"), True
    if kind == "b":
        return ("TRUE" if value == "1" else "FALSE"), True
    if kind in ("e", "str"):
        return value or "", True
    if value is None:
        formula = next((x.text for x in cell if local(x) == "f"), None)
        return (f"={formula}" if formula else ""), True
    return value, False


def compound_stream(content: bytes, names: tuple[str, ...]) -> bytes:
    """A stream of an OLE2 compound file."""
    if content[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("not a compound file")
    shift, mini_shift = struct.unpack_from("<HH", content, 30)
    size, mini = 1 << shift, 1 << mini_shift
    n_fat, directory, cutoff, mini_fat, _, difat, n_difat = header(content)
    sector = lambda k: content[(k + 1) * size : (k + 2) * size]
    fat_sectors = [x for x in struct.unpack_from("<109I", content, 76) if x < 0xFFFFFFFA]
    while difat < 0xFFFFFFFA and n_difat > 0:
        block = struct.unpack(f"<{size // 4}I", sector(difat))
        fat_sectors += [x for x in block[:-1] if x < 0xFFFFFFFA]
        difat, n_difat = block[-1], n_difat - 1
    fat = [x for s in fat_sectors[:n_fat] for x in struct.unpack(f"<{size // 4}I", sector(s))]

    def chain(first: int, table: list[int], piece) -> bytes:
        out, seen = [], 0
        while first < 0xFFFFFFFA and first < len(table) and seen <= len(table):
            out.append(piece(first))
            first, seen = table[first], seen + 1
        return b"".join(out)

    entries = chain(directory, fat, sector)
    found = {}
    for at in range(0, len(entries) - 127, 128):
        length = struct.unpack_from("<H", entries, at + 64)[0]
        name = entries[at : at + max(length - 2, 0)].decode("utf-16-le", "replace")
        first, total = struct.unpack_from("<IQ", entries, at + 116)
        found[name] = (first, total & 0xFFFFFFFF)
    for name in names:
        if name in found:
            first, total = found[name]
            if total >= cutoff:
                return chain(first, fat, sector)[:total]
            root = chain(found["Root Entry"][0], fat, sector)
            table = list(struct.unpack(f"<{len(raw) // 4}I", raw)) if (raw := chain(mini_fat, fat, sector)) else []
            return chain(first, table, lambda k: root[k * mini : (k + 1) * mini])[:total]
    raise ValueError("stream not found")


def header(content: bytes) -> tuple[int, int, int, int, int, int, int]:
    """FAT sectors, first directory sector, mini cutoff, first mini FAT sector, their number, first DIFAT sector, their number."""
    n_fat, directory = struct.unpack_from("<II", content, 44)
    cutoff, mini_fat, n_mini, difat, n_difat = struct.unpack_from("<IIIII", content, 56)
    return n_fat, directory, cutoff, mini_fat, n_mini, difat, n_difat


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(id, data) of a binary workbook's records; a record that runs past the end stops the scan."""
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        if at + 4 + size > len(stream):
            return
        yield kind, stream[at + 4 : at + 4 + size]
        at += 4 + size


class StringReader:
    """Strings over records and their continuations: the flag of wide characters is read again where a string is split."""

    def __init__(self, chunks: list[bytes]):
        self.chunks, self.k, self.at = chunks, 0, 0

    def left(self) -> int:
        return len(self.chunks[self.k]) - self.at

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if not self.left():
                if self.k + 1 == len(self.chunks):
                    raise ValueError("string past the end")
                self.k, self.at = self.k + 1, 0
            piece = self.chunks[self.k][self.at : self.at + n]
            self.at, n, out = self.at + len(piece), n - len(piece), out + piece
        return out

    def characters(self, n: int, wide: bool) -> str:
        out = []
        while n:
            if not self.left():
                if self.k + 1 == len(self.chunks):
                    raise ValueError("string past the end")
                self.k, self.at = self.k + 1, 0
                wide = bool(self.take(1)[0] & 1)
            some = min(n, self.left() // (2 if wide else 1))
            if not some:
                raise ValueError("split character")
            out.append(self.take(some * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= some
        return "".join(out)

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        text = self.characters(n, bool(flags & 1))
        self.take(4 * runs + extra)
        return text


def short_string(data: bytes, wide_length: bool) -> str:
    n = struct.unpack_from("<H", data)[0] if wide_length else data[0]
    at = 2 if wide_length else 1
    wide = data[at] & 1
    return data[at + 1 : at + 1 + n * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace")


def rk_number(rk: int) -> float:
    value = float(rk >> 2 if rk < 1 << 31 else (rk >> 2) - (1 << 30)) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & 0xFFFFFFFC) << 32))[0]
    return value / 100 if rk & 1 else value


def number_text(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def xls(content: bytes) -> tuple[list[dict], list[dict]]:
    """(cells, merges) of a binary workbook of version 8."""
    stream = compound_stream(content, ("Workbook", "Book"))
    sheets, formats, styles, shared, date1904, strings, last = [], {}, [], [], False, [], 0
    for n, (kind, data) in enumerate(records(stream)):
        if n == 0 and (kind != 0x809 or struct.unpack_from("<H", data)[0] != 0x600):
            raise ValueError("not version 8")
        if kind == 0x85:
            at, state = struct.unpack_from("<IB", data)
            sheets.append((at, short_string(data[6:], False), state & 3 != 0))
        elif kind == 0x22:
            date1904 = data[:2] == b"\1\0"
        elif kind == 0x41E:
            formats[struct.unpack_from("<H", data)[0]] = short_string(data[2:], True)
        elif kind == 0xE0:
            styles.append(struct.unpack_from("<H", data, 2)[0])
        elif kind == 0xFC:
            strings = [data]
        elif kind == 0x3C and last in (0xFC, 0x3C) and strings:
            strings.append(data)
        elif kind == 0x0A:
            break
        if kind != 0x3C or last not in (0xFC, 0x3C):
            last = kind
    if strings:
        total = struct.unpack_from("<I", strings[0], 4)[0]
        reader = StringReader([strings[0][8:], *strings[1:]])
        shared = [reader.string() for _ in range(total)]
    cells, merges = [], []
    for k, (at, name, hidden) in enumerate(sheets):
        head = {"sheet": k, "sheet_name": name, "sheet_hidden": hidden, "date1904": date1904}
        hidden_rows, hidden_cols, own, pending = set(), set(), [], None
        for kind, d in records(stream, at):
            if kind == 0x0A:
                break
            if kind == 0x208:
                if struct.unpack_from("<H", d, 12)[0] & 0x20:
                    hidden_rows.add(struct.unpack_from("<H", d)[0])
            elif kind == 0x7D:
                first, end, _, _, flags = struct.unpack_from("<HHHHH", d)
                if flags & 1:
                    hidden_cols.update(range(first, end + 1))
            elif kind == 0xE5:
                for j in range(struct.unpack_from("<H", d)[0]):
                    r1, r2, c1, c2 = struct.unpack_from("<HHHH", d, 2 + 8 * j)
                    merges.append({"sheet": k, "r1": r1, "c1": c1, "r2": r2, "c2": c2})
            elif kind == 0xFD:
                r, c, x, s = struct.unpack_from("<HHHI", d)
                own.append((r, c, x, shared[s] if s < len(shared) else "", True))
            elif kind == 0x204:
                r, c, x = struct.unpack_from("<HHH", d)
                own.append((r, c, x, short_string(d[6:], True), True))
            elif kind == 0x203:
                r, c, x, v = struct.unpack_from("<HHHd", d)
                own.append((r, c, x, number_text(v), False))
            elif kind == 0x27E:
                r, c, x, rk = struct.unpack_from("<HHHI", d)
                own.append((r, c, x, number_text(rk_number(rk)), False))
            elif kind == 0xBD:
                r, c = struct.unpack_from("<HH", d)
                for j in range((len(d) - 6) // 6):
                    x, rk = struct.unpack_from("<HI", d, 4 + 6 * j)
                    own.append((r, c + j, x, number_text(rk_number(rk)), False))
            elif kind == 0x205:
                r, c, x, v, is_error = struct.unpack_from("<HHHBB", d)
                own.append((r, c, x, ERRORS.get(v, "#ERR!") if is_error else "TRUE" if v else "FALSE", True))
            elif kind == 0x06:
                r, c, x = struct.unpack_from("<HHH", d)
                if d[12:14] == b"\xff\xff":
                    if d[6] == 0:
                        pending = (r, c, x)
                    else:
                        own.append((r, c, x, ("TRUE" if d[8] else "FALSE") if d[6] == 1 else ERRORS.get(d[8], "#ERR!") if d[6] == 2 else "", True))
                else:
                    own.append((r, c, x, number_text(struct.unpack_from("<d", d, 6)[0]), False))
            elif kind == 0x207 and pending:
                own.append((*pending, short_string(d, True), True))
                pending = None
        for r, c, x, raw, plain in own:
            format_id = styles[x] if x < len(styles) else 0
            cells.append(head | {"row": r, "col": c, "raw": raw, "format_id": format_id, "format_code": None if plain else formats.get(format_id, BUILTIN.get(format_id)), "row_hidden": r in hidden_rows, "col_hidden": c in hidden_cols})
    return cells, merges


def docx(content: bytes) -> str:
    """Body of a word-processor document as HTML: headings, lists, runs with styles, links, tables with spans."""
    archive = Archive(content)
    root = archive.xml("word/document.xml")
    if root is None:
        raise ValueError("no document")
    links = relations(archive, "word/document.xml")
    counter = [0]

    def runs(p: ElementTree.Element) -> str:
        out = []
        for c in p:
            if local(c) == "hyperlink":
                inner, href = runs(c), links.get(attribute(c, "id") or "", "")
                out.append(f'<a href="{escape(href)}">{inner}</a>' if href else inner)
            elif local(c) == "r":
                props = {local(x): attribute(x, "val") for pr in c if local(pr) == "rPr" for x in pr}
                text = ""
                for x in c:
                    if local(x) == "t":
                        text += escape(x.text or "", quote=False)
                    elif local(x) in ("br", "cr"):
                        text += "<br>"
                    elif local(x) == "tab":
                        text += " "
                    elif local(x) == "drawing":
                        counter[0] += 1
                        alt = next((attribute(y, "descr") or attribute(y, "name") or "" for y in find(x, "docPr")), "")
                        target = next((links.get(attribute(y, "embed") or "", "") for y in find(x, "blip")), "")
                        text += f'<img src="img_{counter[0]:03d}{posixpath.splitext(target)[1].lower()}" alt="{escape(alt)}">'
                for tag, key in (("del", "strike"), ("em", "i"), ("strong", "b")):
                    if key in props and props[key] not in ("0", "false") and text:
                        text = f"<{tag}>{text}</{tag}>"
                out.append(text)
            elif local(c) in ("ins", "smartTag", "sdt", "sdtContent"):
                out.append(runs(c))
        return "".join(out)

    def body(node: ElementTree.Element) -> str:
        out, items = [], []

        def flush() -> None:
            if items:
                out.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
                items.clear()

        for c in node:
            if local(c) == "p":
                props = {local(x): x for pr in c if local(pr) == "pPr" for x in pr}
                style = attribute(props["pStyle"], "val") or "" if "pStyle" in props else ""
                level = re.fullmatch(r"(?i)heading\s*([1-6])|([1-6])", style)
                text = runs(c)
                if "numPr" in props:
                    items.append(text)
                    continue
                flush()
                tag = f"h{level[1] or level[2]}" if level else "h1" if style.lower() == "title" else "p"
                if text.strip():
                    out.append(f"<{tag}>{text}</{tag}>")
            elif local(c) == "tbl":
                flush()
                out.append(table(c))
            elif local(c) in ("sdt", "sdtContent"):
                flush()
                out.append(body(c))
        flush()
        return "".join(out)

    def table(t: ElementTree.Element) -> str:
        rows, open_at = [], {}
        for tr in (x for x in t if local(x) == "tr"):
            cells, col = [], 0
            for tc in (x for x in tr if local(x) == "tc"):
                props = {local(x): attribute(x, "val") for pr in tc if local(pr) == "tcPr" for x in pr}
                width = int(props.get("gridSpan") or 1)
                if "vMerge" in props and props["vMerge"] != "restart" and col in open_at:
                    open_at[col]["rows"] += 1
                else:
                    cell = {"html": body(tc), "cols": width, "rows": 1}
                    cells.append(cell)
                    open_at.pop(col, None)
                    if props.get("vMerge") == "restart":
                        open_at[col] = cell
                col += width
            rows.append(cells)
        return "<table>" + "".join("<tr>" + "".join(f'<td colspan="{c["cols"]}" rowspan="{c["rows"]}">{c["html"]}</td>' for c in r) + "</tr>" for r in rows) + "</table>"

    found = next(find(root, "body"), None)
    return "" if found is None else body(found)


def hwpx(content: bytes) -> str:
    """Sections of a HWPX document in the order of its spine, as HTML."""
    archive = Archive(content)
    level, strong, em, struck, lists = {}, set(), set(), set(), set()
    head = archive.xml("Contents/header.xml")
    if head is not None:
        from ..functions.text import LIST_STYLE, STYLE_LEVELS

        for s in find(head, "style"):
            name = s.get("name", "")
            for pattern, n in STYLE_LEVELS:
                if re.match(pattern.replace(r"\z", r"\Z"), name):
                    level[s.get("id")] = n
            if name.startswith(LIST_STYLE):
                lists.add(s.get("id"))
        for c in find(head, "charPr"):
            for x in c:
                shape = x.get("shape")
                if local(x) == "bold":
                    strong.add(c.get("id"))
                elif local(x) == "italic":
                    em.add(c.get("id"))
                elif local(x) == "strikeout" and (shape is None or shape in STRIKE_SHAPES):
                    struck.add(c.get("id"))
    spine = archive.xml("Contents/content.hpf")
    parts = []
    if spine is not None:
        items = {x.get("id"): x.get("href", "") for x in find(spine, "item")}
        for ref in find(spine, "itemref"):
            href = items.get(ref.get("idref"), "")
            if href and "header" not in posixpath.basename(href):
                parts.append(href if archive.read(href) is not None else f"Contents/{href}")
    parts = parts or ["Contents/section0.xml"]

    def paragraph(p: ElementTree.Element) -> tuple[str, list[str]]:
        text, tables = [], []
        for run in (x for x in p if local(x) == "run"):
            ref, inner = run.get("charPrIDRef"), ""
            for x in run:
                if local(x) == "t":
                    inner += escape("".join(x.itertext()), quote=False)
                elif local(x) == "tbl":
                    tables.append(grid(x))
            for tag, ids in (("del", struck), ("em", em), ("strong", strong)):
                if inner and ref in ids:
                    inner = f"<{tag}>{inner}</{tag}>"
            text.append(inner)
        joined = "".join(text)
        for tag in ("strong", "em", "del"):
            joined = joined.replace(f"</{tag}><{tag}>", "")
        return joined, tables

    def grid(t: ElementTree.Element) -> str:
        rows = []
        for tr in (x for x in t if local(x) == "tr"):
            cells = []
            for tc in (x for x in tr if local(x) == "tc"):
                size = next((x for x in tc if local(x) == "cellSpan"), None)
                spans = (size.get("colSpan", "1"), size.get("rowSpan", "1")) if size is not None else ("1", "1")
                texts, inside = [], []
                for p in (y for s in tc if local(s) == "subList" for y in s if local(y) == "p"):
                    text, tables = paragraph(p)
                    if text.strip():
                        texts.append(text)
                    inside += tables
                joined = (" " if len(texts) <= 2 else " / ").join(texts)
                cells.append(f'<td colspan="{spans[0]}" rowspan="{spans[1]}">{"<br>".join([x for x in [joined] if x] + inside)}</td>')
            rows.append("<tr>" + "".join(cells) + "</tr>")
        return "<table>" + "".join(rows) + "</table>"

    out, items, found = [], [], False
    for part in parts:
        root = archive.xml(part)
        if root is None:
            continue
        found = True
        for p in (x for x in root if local(x) == "p"):
            text, tables = paragraph(p)
            style = p.get("styleIDRef")
            if style in lists and text.strip() and not tables:
                items.append(text)
                continue
            if items:
                out.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
                items = []
            out += tables
            if text.strip():
                tag = f"h{level[style]}" if style in level else "p"
                out.append(f"<{tag}>{text}</{tag}>")
    if items:
        out.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
    if not found:
        raise ValueError("no sections")
    return "".join(out)


READERS = {"xlsx": xlsx, "xls": xls}
TEXT_READERS = {"docx": docx, "hwpx": hwpx}


def contents(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes | None]]:
    """(path, content) file by file."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            yield path, content


def read_sheets(found: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(cells, merges) of workbooks given as path and content; each file is parsed once a table."""
    reader, cell_names = READERS[kind], [x.split()[0] for x in CELLS.split(", ")]

    def rows(which: int, names: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = []
            for path, content in contents(batches):
                try:
                    made = reader(bytes(content))[which]
                except Exception as e:
                    made = [{"error": f"{type(e).__name__}: {e}"}] if which == 0 else []
                for x in made:
                    out.append(tuple((path if c == "path" else x.get(c)) for c in names))
                    if len(out) >= ROWS_OUT:
                        yield pd.DataFrame(out, columns=names, dtype=object)
                        out = []
            yield pd.DataFrame(out, columns=names, dtype=object)

        return run

    cells = found.select("path", "content").mapInPandas(rows(0, cell_names), CELLS)
    merges = found.select("path", "content").mapInPandas(rows(1, [x.split()[0] for x in MERGES.split(", ")]), MERGES)
    return cells, merges


def read_text(found: DataFrame, kind: str) -> DataFrame:
    """path, html, markdown, error of text documents."""
    reader = TEXT_READERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, out, size = ["path", "html", "markdown", "error"], [], 0
        for path, content in contents(batches):
            try:
                html = reader(bytes(content))
                out.append((path, html, markup.to_markdown(markup.parse(html)), None))
                size += 2 * len(html)
            except Exception as e:
                out.append((path, None, None, f"{type(e).__name__}: {e}"))
            if len(out) >= ROWS_OUT or size >= BYTES_OUT:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out, size = [], 0
        yield pd.DataFrame(out, columns=names, dtype=object)

    return found.select("path", "content").mapInPandas(run, "path string, html string, markdown string, error string")


def drawn_images(archive: Archive, part: str) -> list[tuple[str, str]]:
    """(member, alternative text) of the pictures of a sheet's drawings, in order of their anchors."""
    out = []
    for target in relations(archive, part).values():
        if "/drawings/" not in f"/{target}" or not target.endswith(".xml"):
            continue
        root, media = archive.xml(target), relations(archive, target)
        for pic in find(root, "pic") if root is not None else ():
            named = next(find(pic, "cNvPr"), None)
            alt = "" if named is None else named.get("descr") or named.get("name") or ""
            member = next((media.get(attribute(x, "embed") or "") for x in find(pic, "blip")), None)
            if member:
                out.append((member, alt))
    return out


def images(content: bytes, kind: str) -> list[dict]:
    """Pictures of a document in encounter order, numbered: name, alt, member, data."""
    archive, found = Archive(content), []
    if kind == "xlsx":
        book, targets = archive.xml("xl/workbook.xml"), relations(archive, "xl/workbook.xml")
        for s in find(book, "sheet") if book is not None else ():
            found += drawn_images(archive, targets.get(attribute(s, "id") or "", ""))
    elif kind == "docx":
        root, links = archive.xml("word/document.xml"), relations(archive, "word/document.xml")
        for x in find(root, "drawing") if root is not None else ():
            alt = next((attribute(y, "descr") or attribute(y, "name") or "" for y in find(x, "docPr")), "")
            found += [(links.get(attribute(y, "embed") or "", ""), alt) for y in find(x, "blip")]
    else:
        found = [(x, "") for x in sorted(archive.names) if x.startswith("BinData/")]
    out = []
    for member, alt in found:
        data = archive.read(member) if member else None
        if data is not None:
            out.append({"name": f"img_{len(out) + 1:03d}{posixpath.splitext(member)[1].lower()}", "alt": alt, "member": member, "data": data})
    return out


def read_images(found: DataFrame, kind: str) -> DataFrame:
    """path, name, alt, member, data: one row a picture; files that can't be read have none here, their error is with the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = images(bytes(content), kind)
                except Exception:
                    rows = []
                yield pd.DataFrame([{"path": path} | x for x in rows], columns=["path", "name", "alt", "member", "data"], dtype=object)

    return found.select("path", "content").mapInPandas(run, "path string, name string, alt string, member string, data binary")
