"""Queries over readers: files are made from rows of ``part``, read back, and compared with SQL over the same rows.

A file holds the parts of one range of keys, so files grow in number with the table, not in size.
"""

from __future__ import annotations

from collections.abc import Callable
from html import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import workbook as W
from ..sources import containers as N
from ..sources.builders import archive, build_xls, build_xlsx
from .registry import query, spread, table

#: Parts of one file.
PER_FILE = 20
BOOK = f"'book' || cast(p_partkey div {PER_FILE} as string)"
BOOK_SQL = f"'book' || CAST(p_partkey // {PER_FILE} AS VARCHAR)"
DAY_SQL = "strftime(DATE '1899-12-30' + CAST(40000 + p_partkey % 5000 AS INT), '%Y-%m-%d')"
W_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def made(spark: SparkSession, d: str, build: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """path, content: a file of each range of parts, in order of their keys."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [frame["path"].iloc[0]], "content": [build(frame.sort_values("p_partkey"))]})

    parts = table(spark, d, "part").selectExpr(f"{BOOK} AS path", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return spread(parts, "path").groupBy("path").applyInPandas(one, "path string, content binary")


def sheet(f: pd.DataFrame) -> list[dict]:
    rows = [[n, int(s), int(40000 + k % 5000)] for n, s, k in zip(f["p_name"], f["p_size"], f["p_partkey"], strict=True)]
    return [{"name": "Parts", "rows": rows, "formats": {2: "yyyy-mm-dd"}}]


CELLS_SQL = f"SELECT {BOOK_SQL} AS path, 'Parts' AS sheet_name, CAST(p_partkey % {PER_FILE} AS INT) AS row, p_name AS name, CAST(p_size AS VARCHAR) AS size, {DAY_SQL} AS day FROM part"
RENDER_SQL = f"""WITH l AS (SELECT {BOOK_SQL} AS path, p_partkey, '| ' || p_name || ' | ' || p_size || ' | ' || {DAY_SQL} || ' |' || CASE WHEN p_partkey % {PER_FILE} = 0 THEN chr(10) || '| --- | --- | --- |' ELSE '' END AS line FROM part)
SELECT path, '## Parts' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY p_partkey) AS markdown FROM l GROUP BY path"""


def by_row(found: DataFrame) -> DataFrame:
    wide = W.texts(found).groupBy("path", "sheet_name", "row").pivot("col", [0, 1, 2]).agg(F.first("text"))
    return wide.select("path", "sheet_name", "row", F.col("0").alias("name"), F.col("1").alias("size"), F.col("2").alias("day"))


@query(CELLS_SQL)
def q_xlsx_cells(spark: SparkSession, d: str) -> DataFrame:
    """Zipped workbooks: shared strings, numbers and a date format."""
    return by_row(N.read_sheets(made(spark, d, lambda f: build_xlsx(sheet(f))), "xlsx")[0])


@query(CELLS_SQL)
def q_xls_cells(spark: SparkSession, d: str) -> DataFrame:
    """Binary workbooks in compound files: string tables, packed numbers and a date format."""
    return by_row(N.read_sheets(made(spark, d, lambda f: build_xls(sheet(f))), "xls")[0])


@query(RENDER_SQL)
def q_workbook_render(spark: SparkSession, d: str) -> DataFrame:
    """Workbooks to Markdown, end to end."""
    cells, merges = N.read_sheets(made(spark, d, lambda f: build_xlsx(sheet(f))), "xlsx")
    return W.render(cells, merges).select("path", "markdown")


def docx(f: pd.DataFrame) -> bytes:
    run = lambda text, marks="": f'<w:r><w:rPr>{marks}</w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>{run(f["path"].iloc[0])}</w:p>'
    for n, t, k in zip(f["p_name"], f["p_type"], f["p_partkey"], strict=True):
        body += f"<w:p>{run(n, '<w:b/>')}{run(' is ')}{run(t, '<w:i/>' if k % 2 else '')}</w:p>"
    cell = lambda text, extra="": f"<w:tc><w:tcPr>{extra}</w:tcPr><w:p>{run(text)}</w:p></w:tc>"
    rows = f'<w:tr>{cell("all", "<w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/>")}</w:tr>'
    rows += "".join(f"<w:tr>{cell(b)}{cell(str(s))}</w:tr>" for b, s in zip(f["p_brand"], f["p_size"], strict=True))
    return archive({"word/document.xml": f"<w:document {W_NS}><w:body>{body}<w:tbl>{rows}</w:tbl></w:body></w:document>"})


@query(f"""WITH p AS (SELECT {BOOK_SQL} AS path, p_partkey, '**' || p_name || '** is ' || CASE WHEN p_partkey % 2 = 1 THEN '*' || p_type || '*' ELSE p_type END AS para, '| ' || p_brand || ' | ' || p_size || ' |' AS line FROM part)
SELECT path, '## ' || path || chr(10) || chr(10) || string_agg(para, chr(10) || chr(10) ORDER BY p_partkey) || chr(10) || chr(10) || '| all | ← |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY p_partkey) AS markdown FROM p GROUP BY path""")
def q_docx_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Word documents: headings, bold and italic runs, a table with a merged row."""
    return N.read_text(made(spark, d, docx), "docx").select("path", "markdown")


def hwpx(f: pd.DataFrame) -> bytes:
    head = '<head><styles><style id="1" name="1.1 부제목"/><style id="2" name="나열 1"/></styles><charPr id="7"><bold/></charPr></head>'
    body = f'<p styleIDRef="1"><run><t>{f["path"].iloc[0]}</t></run></p>'
    body += "".join(f'<p styleIDRef="2"><run charPrIDRef="7"><t>{escape(n)}</t></run><run><t> is {escape(t)}</t></run></p>' for n, t in zip(f["p_name"], f["p_type"], strict=True))
    cell = lambda text, cols=1, rows=1: f'<tc><cellSpan colSpan="{cols}" rowSpan="{rows}"/><subList><p><run><t>{escape(text)}</t></run></p></subList></tc>'
    lines = f"<tr>{cell('all', cols=2)}</tr>" + "".join(f"<tr>{cell(b)}{cell(str(s))}</tr>" for b, s in zip(f["p_brand"], f["p_size"], strict=True))
    section = f"<sec>{body}<p><run><tbl>{lines}</tbl></run></p></sec>"
    return archive({"Contents/header.xml": head, "Contents/content.hpf": '<package><item id="s" href="Contents/section0.xml"/><itemref idref="s"/></package>', "Contents/section0.xml": section})


@query(f"""WITH p AS (SELECT {BOOK_SQL} AS path, p_partkey, '- **' || p_name || '** is ' || p_type AS item, '| ' || p_brand || ' | ' || p_size || ' |' AS line FROM part)
SELECT path, '## ' || path || chr(10) || chr(10) || string_agg(item, chr(10) ORDER BY p_partkey) || chr(10) || chr(10) || '| all | ← |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY p_partkey) AS markdown FROM p GROUP BY path""")
def q_hwpx_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Zipped XML documents: heading and list styles, bold runs, a table with a merged row."""
    return N.read_text(made(spark, d, hwpx), "hwpx").select("path", "markdown")


#: A page around each part: what goes (scripts, menus, dangerous links, styles), and what stays in each form.
PAGE = """concat('<html><head><title>', p_name, '</title><style>p{}</style></head><body><nav><a href="/x">menu</a></nav><script>var a="</p>";</script><main><h1>', p_name, '</h1><h3>', p_type, '</h3>',
 '<p onclick="x()">A <b>bold</b> and <em>leaning</em> <del>gone</del> <code>', p_brand, '</code> part, see <a href="/p/', cast(p_partkey as string), '">its page</a> or <a href="javascript:go()">none</a>.<br>Next line</p>',
 '<ul><li>one ', p_brand, '</li><li>two<ul><li>inner</li></ul></li></ul><ol><li>first</li><li>second</li></ol><blockquote><p>', p_name, '</p></blockquote><pre><code>x = ', cast(p_size as string), '</code></pre><hr>',
 '<table><tr><th>a</th><th>b|c</th><th>d</th></tr><tr><td colspan="2">', p_brand, '</td><td rowspan="2">', cast(p_size as string), '</td></tr><tr><td>1</td><td></td></tr></table>',
 '<p><img src="/i.png" alt="pic"> end &amp; &lt;done&gt;</p></main><footer>foot</footer></body></html>')"""


@query("""SELECT p_partkey, concat_ws(chr(10), '# ' || p_name, '', '### ' || p_type, '',
  'A **bold** and *leaning* ~~gone~~ `' || p_brand || '` part, see [its page](https://h.example/p/' || p_partkey || ') or none.', 'Next line', '',
  '- one ' || p_brand, '- two', '  - inner', '', '1. first', '2. second', '', '> ' || p_name, '', '```', 'x = ' || p_size, '```', '', '---', '',
  '| a | b\\|c | d |', '| --- | --- | --- |', '| ' || p_brand || ' | ← | ' || p_size || ' |', '| 1 |  | ↑ |', '', '![pic](https://h.example/i.png) end & <done>') AS markdown FROM part""")
def q_page_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Pages to Markdown: sanitised, main part, links made absolute, every kind of block."""
    parts = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    pages = parts.selectExpr("p_partkey", f"{PAGE} AS html")
    return pages.select("p_partkey", H.page_markdown(F.col("html"), F.lit("https://h.example/dir/page.html")).alias("markdown"))
