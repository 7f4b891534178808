"""Single functions on hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperloom.functions import cellformat as C
from paperloom.functions import html as H
from paperloom.functions import markup as K
from paperloom.functions import routing as R
from paperloom.functions import safety as S
from paperloom.functions import sql
from paperloom.functions import text as T


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["_"]) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "format_id", "custom", "old", "shown"), [
    ("38353", 14, None, False, "2005-01-01"), ("32", 14, None, False, "1900-02-01"), ("365", 14, None, True, "1904-12-31"),
    ("38353.25", 22, None, False, "2005-01-01 06:00:00"), ("0.0625", 10, None, False, "6.25%"), ("0.348", 9, None, False, "35%"),
    ("20480017", 3, None, False, "20,480,017"), ("-12", 14, None, False, "-12"), ("abc", 2, None, False, "abc"), ("", 2, None, False, ""),
    ("1234.5", 164, '"₩"#,##0.00"원"', False, "₩1,234.50원"), ("1.005", 2, None, False, "1.00"), ("0.5", 1, None, False, "1"), ("-0.001", 2, None, False, "-0.00"),
    ("7", 49, None, False, "7"), ("5", 999, None, False, "5"),
])
def test_cell_format(spark, raw, format_id, custom, old, shown):
    frame = spark.createDataFrame([(raw, format_id, custom, old)], "raw string, id int, custom string, old boolean")
    made = frame.select(C.format_cell(F.col("raw"), C.format_code(F.col("id"), F.col("custom")), F.col("old")).alias("x"))
    assert made.first()["x"] == shown


@pytest.mark.parametrize(("ip", "blocked"), [
    ("127.0.0.1", True), ("10.1.2.3", True), ("172.31.0.1", True), ("172.32.0.1", False), ("8.8.8.8", False), ("198.19.255.255", True), ("239.1.1.1", True),
    ("::1", True), ("::", True), ("fd00::1", True), ("fe80::1", True), ("ff02::1", True), ("2001:db8::1", False), ("::ffff:10.0.0.1", True), ("::ffff:8.8.8.8", False),
    ("256.1.1.1", True), ("host", True), (None, True), ("", True),
])
def test_blocked_ip(spark, ip, blocked):
    assert spark.createDataFrame([(ip,)], "ip string").select(S.is_blocked_ip(F.col("ip")).alias("x")).first()["x"] is blocked


@pytest.mark.parametrize(("header", "name"), [
    ('attachment; filename="ledger 7.xls"', "ledger 7.xls"), ("attachment; filename=plain.docx", "plain.docx"), ("attachment; filename*=UTF-8''%ED%95%9C.hwp", "한.hwp"),
    ("attachment; filename=\"x.pdf\"; filename*=UTF-8''y.pdf", "y.pdf"), ('attachment; filename="../../etc/passwd"', ".._.._etc_passwd"), ("inline", None), (None, None), ('attachment; filename="\xed\x95\x9c.hwp"', "한.hwp"), ('attachment; filename="caf\xe9.pdf"', "café.pdf"),
])
def test_disposition(spark, header, name):
    assert spark.createDataFrame([(header,)], "h string").select(R.disposition_name(F.col("h")).alias("x")).first()["x"] == name


@pytest.mark.parametrize(("url", "slug"), [
    ("https://shop.test/a/b-c/", "shop_test_a_b_c"), ("https://example.com/%ED%95%9C%EA%B8%80?q=1#x", "example_com_한글"), ("https://example.com/%zz", "example_com_zz"),
    ("ftp://example.com/", "page"), ("https://example.com/" + "a" * 200, ("example_com_" + "a" * 200)[:80]),
])
def test_url_slug(spark, url, slug):
    assert spark.createDataFrame([(url,)], "u string").select(R.url_slug(F.col("u")).alias("x")).first()["x"] == slug


def test_text_scalars(spark):
    frame = spark.createDataFrame([("Ⅳ Hello,  World!", "a​b", "\U000f0310", 5)], "s string, z string, p string, n int")
    row = frame.select(T.slugify(F.col("s")).alias("slug"), T.strip_zero_width(F.col("z")).alias("zw"), T.normalize_symbols(F.col("p")).alias("sym"), T.image_name(F.col("n"), F.lit("png")).alias("img")).first()
    assert row["slug"] == "iv-hello-world" and row["zw"] == "ab" and row["sym"][0] == "■" and row["img"] == "img_005.png"


@pytest.mark.parametrize(("content", "kind", "text"), [
    ("가".encode("euc-kr"), "text/html; charset=euc-kr", "가"), (b"<meta charset='euc-kr'>" + "나".encode("euc-kr"), None, "<meta charset='euc-kr'>나"),
    ("é".encode(), "text/html; charset=nonsense", "é"), ("é".encode("latin-1") + b"<meta charset=utf-8>", "text/html; charset=latin-1", "é<meta charset=utf-8>"),
])
def test_decode(content, kind, text):
    assert H.decode_bytes(content, kind) == text


@pytest.mark.parametrize(("html", "markdown"), [
    ("<h2>T</h2><p>a <b>b</b> <i>c</i> <del>d</del></p>", "## T\n\na **b** *c* ~~d~~"), ("<ul><li>x<li>y</ul>", "- x\n- y"), ("<ol><li>x</li><li>y</li></ol>", "1. x\n2. y"),
    ("<pre><code class='language-py'>x = 1\n</code></pre>", "```py\nx = 1\n```"), ("<hr>", "---"), ("<p><a href='/x'>l</a><img src='i.png' alt='A'></p>", "[l](/x)![A](i.png)"),
    ("<table><tr><td colspan=2>a</td></tr><tr><td rowspan=2>b</td><td>c|d</td></tr><tr><td>e<br>f</td></tr></table>", "| a | ← |\n| --- | --- |\n| b | c\\|d |\n| ↑ | e<br>f |"),
    ("<table><tr><td>x<table><tr><td>1</td><td>2</td></tr></table></td></tr></table>", "| x<br>(표 1×2)<br>1 · 2 |\n| --- |"), ("<script>x</script><p>a<p>b", "a\n\nb"),
])
def test_markdown(html, markdown):
    assert K.to_markdown(K.parse(html)) == markdown


def test_sanitize_and_content():
    clean = K.to_html(K.sanitize(K.parse("<p onclick='x()'><a href=' java\tscript:1'>a</a><img data-src='/i.png' src='data:image/gif;base64,x'><iframe></iframe></p>"), "https://h.example/d/"))
    assert clean == '<p><a>a</a><img src="https://h.example/i.png"></p>'
    page = "<title>T</title><nav>menu</nav><article><p>" + "word " * 30 + "</p></article><footer>f</footer>"
    made = K.page_to_markdown(page, "https://h.example/")
    assert made.startswith("# T\n\nword") and "menu" not in made


def test_frame_target(spark):
    page = "<title>t</title><frameset><frame src='a.html' name='x'><frame name='mainFrame' src='b.html'></frameset>"
    assert spark.createDataFrame([(page,)], "h string").select(H.frame_target(F.col("h")).alias("x")).first()["x"] == "b.html"


def test_sql_names(spark):
    assert "html_to_markdown" in sql.register(spark)
    assert spark.sql("SELECT html_to_markdown('<h1>a</h1>') AS x, md_nfc('é') AS y").first()[:] == ("# a", "é")
