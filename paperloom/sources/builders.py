"""Minimal writers of office containers: export for small tables, and inputs for tests."""

from __future__ import annotations

import io
import struct
import zipfile
from html import escape

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def column_name(k: int) -> str:
    name = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        name = chr(65 + r) + name
    return name


def archive(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(zipfile.ZipInfo(name), text)  # a fixed date, so equal input gives equal bytes
    return out.getvalue()


def build_xlsx(sheets: list[dict]) -> bytes:
    """Sheets: name, rows (lists of str, number or None), merges [(r1, c1, r2, c2)], hidden_rows, hidden_cols, hidden, formats {col: code}."""
    strings: list[str] = []
    index: dict[str, int] = {}
    codes: list[str] = []
    parts = {}
    for k, s in enumerate(sheets):
        formats = s.get("formats", {})
        body = []
        for r, row in enumerate(s["rows"]):
            cells = []
            for c, v in enumerate(row):
                ref = f"{column_name(c)}{r + 1}"
                if v is None:
                    continue
                if isinstance(v, str):
                    if v not in index:
                        index[v] = len(strings)
                        strings.append(v)
                    cells.append(f'<c r="{ref}" t="s"><v>{index[v]}</v></c>')
                else:
                    style = 0
                    if c in formats:
                        if formats[c] not in codes:
                            codes.append(formats[c])
                        style = codes.index(formats[c]) + 1
                    cells.append(f'<c r="{ref}" s="{style}"><v>{v}</v></c>')
            hidden = ' hidden="1"' if r in s.get("hidden_rows", ()) else ""
            body.append(f'<row r="{r + 1}"{hidden}>{"".join(cells)}</row>')
        cols = "".join(f'<col min="{c + 1}" max="{c + 1}" hidden="1"/>' for c in s.get("hidden_cols", ()))
        merges = "".join(f'<mergeCell ref="{column_name(c1)}{r1 + 1}:{column_name(c2)}{r2 + 1}"/>' for r1, c1, r2, c2 in s.get("merges", ()))
        parts[f"xl/worksheets/sheet{k + 1}.xml"] = f'<worksheet xmlns="{_MAIN}">{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{"".join(body)}</sheetData>{f"<mergeCells>{merges}</mergeCells>" if merges else ""}</worksheet>'
    listed = "".join(f'<sheet name="{escape(s["name"])}" sheetId="{k + 1}" r:id="rId{k + 1}"{" state=" + chr(34) + "hidden" + chr(34) if s.get("hidden") else ""}/>' for k, s in enumerate(sheets))
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{_PACKAGE}">' + "".join(f'<Relationship Id="rId{k + 1}" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(sheets))) + "</Relationships>"
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{_MAIN}">' + "".join(f"<si><t>{escape(x)}</t></si>" for x in strings) + "</sst>"
    fmts = "".join(f'<numFmt numFmtId="{200 + k}" formatCode="{escape(x)}"/>' for k, x in enumerate(codes))
    xfs = '<xf numFmtId="0"/>' + "".join(f'<xf numFmtId="{200 + k}"/>' for k in range(len(codes)))
    parts["xl/styles.xml"] = f'<styleSheet xmlns="{_MAIN}"><numFmts>{fmts}</numFmts><cellXfs>{xfs}</cellXfs></styleSheet>'
    return archive(parts)


def build_xls(sheets: list[dict]) -> bytes:
    """The same sheets as a binary workbook of version 8 in a compound file (strings inline, no continuation records)."""
    record = lambda kind, data=b"": struct.pack("<HH", kind, len(data)) + data
    text = lambda s: struct.pack("<HB", len(s.encode("utf-16-le")) // 2, 1) + s.encode("utf-16-le")
    codes = list(dict.fromkeys(x for s in sheets for x in s.get("formats", {}).values()))
    bodies = []
    for s in sheets:
        out = record(0x809, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 0))
        for c in s.get("hidden_cols", ()):
            out += record(0x7D, struct.pack("<HHHHHH", c, c, 0, 0, 1, 0))
        for r in range(len(s["rows"])):
            out += record(0x208, struct.pack("<HHHHHHI", r, 0, 1, 0, 0, 0, 0)[:12] + struct.pack("<I", 0x20 if r in s.get("hidden_rows", ()) else 0))
        for r, row in enumerate(s["rows"]):
            for c, v in enumerate(row):
                code = s.get("formats", {}).get(c)
                style = codes.index(code) + 1 if code is not None and not isinstance(v, str) else 0
                if isinstance(v, str):
                    out += record(0x204, struct.pack("<HHH", r, c, 0) + text(v))
                elif v is not None:
                    out += record(0x203, struct.pack("<HHHd", r, c, style, v))
        if s.get("merges"):
            out += record(0xE5, struct.pack("<H", len(s["merges"])) + b"".join(struct.pack("<HHHH", r1, r2, c1, c2) for r1, c1, r2, c2 in s["merges"]))
        bodies.append(out + record(0x0A))
    head = record(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    head += b"".join(record(0x41E, struct.pack("<H", 200 + k) + text(x)) for k, x in enumerate(codes))
    head += b"".join(record(0xE0, struct.pack("<HH", 0, x) + b"\0" * 16) for x in [0, *(200 + k for k in range(len(codes)))])
    names = [struct.pack("<BB", len(s["name"].encode("utf-16-le")) // 2, 1) + s["name"].encode("utf-16-le") for s in sheets]
    at = len(head) + sum(4 + 6 + len(n) for n in names) + 4
    bound = b""
    for s, n, b in zip(sheets, names, bodies, strict=True):
        bound += record(0x85, struct.pack("<IBB", at, 1 if s.get("hidden") else 0, 0) + n)
        at += len(b)
    return compound(head + bound + record(0x0A) + b"".join(bodies))


def compound(stream: bytes) -> bytes:
    """A compound file with one stream named Workbook."""
    stream = stream.ljust(4096, b"\0")
    stream += b"\0" * (-len(stream) % 512)
    n = len(stream) // 512
    fats = 1
    while fats * 128 < n + 1 + fats:
        fats += 1
    table = [*range(1, n), 0xFFFFFFFE, 0xFFFFFFFE, *[0xFFFFFFFD] * fats]
    table += [0xFFFFFFFF] * (fats * 128 - len(table))

    def entry(name: str, kind: int, child: int, first: int, size: int) -> bytes:
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child) + b"\0" * 36 + struct.pack("<IQ", first, size)

    directory = (entry("Root Entry", 5, 1, 0xFFFFFFFE, 0) + entry("Workbook", 2, 0xFFFFFFFF, 0, len(stream))).ljust(512, b"\0")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIIII", fats, n, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, n + 1)
    head += b"".join(struct.pack("<I", n + 1 + k if k < fats else 0xFFFFFFFF) for k in range(1, 109))
    return head + stream + directory + struct.pack(f"<{len(table)}I", *table)
