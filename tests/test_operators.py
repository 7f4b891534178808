"""Operators on hand-made tables, and readers on files of our own making."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import grid as G
from paperloom.operators import lines as L
from paperloom.operators import outline as O
from paperloom.operators import runs as U
from paperloom.operators import store as S
from paperloom.operators import workbook as W
from paperloom.sources import containers as N
from paperloom.sources import html_pages as P
from paperloom.sources.builders import archive, build_xls, build_xlsx

DOC = "# Intro\n\nhi\n\n## First\nx\n### Deep\ny\n## Second\n```\n# not\n~~~\n```\n# Intro\nend"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, markdown string")


def test_outline_and_chunks(spark):
    found = {r["anchor"]: r for r in O.chunks(docs(spark, DOC), ["id"]).collect()}
    assert list(found) and set(found) == {"intro", "first", "deep", "second", "intro-1"}
    assert found["deep"]["path"] == ["Intro", "First", "Deep"] and found["first"]["end"] == 8 and found["intro"]["end"] == 13
    assert found["second"]["prev"] == "deep" and found["second"]["next"] == "intro-1" and found["intro-1"]["markdown"] == "# Intro\nend"
    assert O.chunk(docs(spark, DOC), ["id"], path=["Intro", "Second"]).first()["anchor"] == "second"
    assert O.chunk(docs(spark, DOC), ["id"], lines=(-3, 2)).first()["markdown"] == "# Intro\n"
    assert O.chunk(docs(spark, DOC), ["id"], lines=(50, 60)).count() == 0
    with pytest.raises(ValueError):
        O.chunk(docs(spark, DOC), ["id"])


@pytest.mark.parametrize(("before", "after"), [
    ("# A ····· 3\n### B ..... 4\n# C ... 5", "- A — 3\n  - B — 4\n# C ... 5"), ("### a\n\n### b\n### c\n# T\nx", "a\n\nb\nc\n# T\nx"), ("## Says so.\n## Why?", "Says so.\n## Why?"), (" x  \n y", "x\ny"),
])
def test_repair(spark, before, after):
    assert L.repair(docs(spark, before), ["id"]).first()["markdown"] == after


def test_empty_rows(spark):
    md = "|  |  |\n| --- | --- |\n| a | b |\n| ** | <br> |\n```\n|  |  |\n```"
    left = L.joined_lines(L.drop_empty_rows(L.explode_lines(docs(spark, md)), ["id"]), ["id"]).first()["markdown"]
    assert left == "|  |  |\n| --- | --- |\n| a | b |\n```\n|  |  |\n```"


def test_runs(spark):
    runs = [(1, k, 50 + 0.4 * k, 12.5, 6.0, 20.0, "a", "f") for k in range(9)] + [(1, 30, 10.0, 40.0, 5.0, 8.0, "b", "f"), (1, 31, 15.5, 40.3, 5.0, 8.0, "c", "g"), (1, 32, 30.0, 40.0, 5.0, 8.0, "d", "f")]
    frame = spark.createDataFrame(runs, "page int, seq int, x double, y double, width double, height double, text string, font string")
    kept = U.drop_overdraws(frame, ["page"])
    assert kept.count() == 4
    assert [r["text"] for r in U.merge_adjacent(kept, ["page"]).orderBy("seq").collect()] == ["a", "bc", "d"]


def test_store(spark, tmp_path):
    store = S.ConversionStore(spark, str(tmp_path / "s"), "conversion_id string, markdown string")
    rows = spark.createDataFrame([("a" * 64, "x"), ("b" * 64, "y"), ("a" * 64, "x")], "conversion_id string, markdown string")
    store.put(rows)
    store.put(rows)
    assert store.list().count() == 2 and store.get("b" * 64).first()["markdown"] == "y"


SHEET = {"name": "S", "rows": [["h", "i", "j", None], ["a", 1.5, 38353, None], ["b", 2, 3, None], [None, None, None, None], ["c", 4, 5, ""]], "merges": [(0, 0, 0, 1), (1, 0, 2, 0)], "hidden_rows": [1], "hidden_cols": [2], "formats": {1: "0.00", 2: "yyyy-mm-dd"}}


def rendered(spark, content, kind, hidden=False):
    frame = spark.createDataFrame([("p", bytearray(content))], "path string, content binary")
    return W.render(*N.read_sheets(frame, kind), include_hidden=hidden).first()


@pytest.mark.parametrize("hidden", [False, True])
def test_spreadsheet_parity(spark, hidden):
    a, b = rendered(spark, build_xlsx([SHEET, SHEET | {"name": "H", "hidden": True}]), "xlsx", hidden), rendered(spark, build_xls([SHEET, SHEET | {"name": "H", "hidden": True}]), "xls", hidden)
    assert a == b
    if not hidden:
        assert a["markdown"] == "## S\n\n| h | ← |\n| --- | --- |\n| a | 2.00 |\n|  |  |\n| c | 4.00 |"
        assert (a["hidden_sheets"], a["hidden_rows"], a["hidden_cols"]) == (1, 1, 1)
    else:
        assert "| a | 1.50 | 2005-01-01 |" in a["markdown"] and "| ↑ | 2.00 |" in a["markdown"] and "## H" in a["markdown"]


def test_bad_file_is_a_row(spark):
    frame = spark.createDataFrame([("p", bytearray(b"junk"))], "path string, content binary")
    assert N.read_sheets(frame, "xlsx")[0].first()["error"] and N.read_sheets(frame, "xls")[0].first()["error"] and N.read_text(frame, "docx").first()["error"]


def test_shared_strings_across_records():
    import struct

    text = "ab" * 10
    first = struct.pack("<HB", 20, 0) + text[:7].encode()
    rest = b"\1" + text[7:].encode("utf-16-le")
    assert N.StringReader([first, rest]).string() == text


W_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_docx(spark):
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>x</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    content = archive({"word/document.xml": f"<w:document {W_NS}><w:body>{body}</w:body></w:document>"})
    made = N.read_text(spark.createDataFrame([("p", bytearray(content))], "path string, content binary"), "docx").first()
    assert made["markdown"] == "# T\n\n**x**\n\n| a | b |\n| --- | --- |\n| ↑ | c |"


def test_hwpx(spark):
    head = '<head><styles><style id="1" name="1. 제목"/><style id="2" name="나열 1"/></styles><charPr id="7"><bold/></charPr></head>'
    section = '<sec><p styleIDRef="1"><run><t>T</t></run></p><p styleIDRef="2"><run><t>x</t></run></p><p styleIDRef="2"><run charPrIDRef="7"><t>y</t></run><run charPrIDRef="7"><t>z</t></run></p><p><run><tbl><tr><tc><cellSpan colSpan="2" rowSpan="1"/><subList><p><run><t>a</t></run></p></subList></tc></tr></tbl></run></p></sec>'
    content = archive({"Contents/header.xml": head, "Contents/content.hpf": '<package><item id="s" href="Contents/section0.xml"/><itemref idref="s"/></package>', "Contents/section0.xml": section})
    made = N.read_text(spark.createDataFrame([("p", bytearray(content))], "path string, content binary"), "hwpx").first()
    assert made["markdown"] == "# T\n\n- x\n- **yz**\n\n| a | ← |\n| --- | --- |"


def test_followed_frames(spark):
    pages = spark.createDataFrame([("https://h/a/x.html", "<frame src='main.html'>"), ("https://h/a/main.html", "<p>" + "w" * 300 + "</p>")], "url string, html string")
    assert all("www" in r["html"] for r in P.followed(pages).collect())


def test_followed_frames_of_repeated_pages(spark):
    shell, main, plain = "<frame src='main.html'>", "<p>" + "w" * 300 + "</p>", "<p>" + "v" * 300 + "</p>"
    rows = [("https://h/a/x.html", shell), ("https://h/a/main.html", main), ("https://h/a/main.html", main), ("https://h/b", plain), (None, plain), ("https://h/c", None)]
    made = sorted((r["url"] or "", r["html"] or "") for r in P.followed(spark.createDataFrame(rows, "url string, html string")).collect())
    assert made == sorted([("https://h/a/main.html", main)] * 3 + [("https://h/b", plain), ("", plain), ("https://h/c", "")])


def test_fences_and_sections_of_long_documents(spark):
    lines = [random.Random(k).choice(["text", "```", "~~~", "# a", "## b", "```x"]) for k in range(2000)]
    made = L.fenced_exactly(spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "d int, markdown string")).where("d = 1").orderBy("line")
    opened, expected = "", []
    for x in lines:
        mark = x[0] if x[0] in "`~" else ""
        expected.append(bool(mark or opened))
        opened = mark if mark and not opened else "" if mark and mark == opened else opened
    assert [r["fenced"] for r in made.collect()] == expected
    found = spark.createDataFrame([(1, k, 1 + k % 3, str(k)) for k in range(30)], "d int, line int, level int, anchor string")
    ends = {r["line"]: r["end"] for r in O.with_sections(found, spark.createDataFrame([(1, 40)], "d int, n_lines long"), ["d"]).collect()}
    assert ends == {k: next((n for n in range(k + 1, 30) if n % 3 <= k % 3), 40) for k in range(30)}


def test_order_of_rows_does_not_matter(spark):
    rows = [(0, r, c, f"{r}{c}") for r in range(6) for c in range(4)]
    random.Random(3).shuffle(rows)
    schema = "sheet int, row int, col int, text string"
    a = G.pipe_tables(spark.createDataFrame(rows, schema), ["sheet"]).first()["markdown"]
    b = G.pipe_tables(spark.createDataFrame(sorted(rows), schema).repartition(3), ["sheet"]).first()["markdown"]
    assert a == b and a.count("\n") == 6


def test_stream_into_store(spark, tmp_path):
    from paperloom.streaming.ingest import ingest

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("one")
    (inbox / "b.txt").write_text("one")
    (inbox / "c.txt").write_text("two")
    store = S.ConversionStore(spark, str(tmp_path / "s"), "conversion_id string, markdown string")
    convert = lambda df: df.select("conversion_id", F.decode("content", "UTF-8").alias("markdown"))
    for _ in range(2):
        ingest(spark, str(inbox), store, convert, str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r["markdown"] for r in store.read().collect()) == ["one", "two"]


def test_failed_conversions_are_retried(spark, tmp_path):
    store = S.ConversionStore(spark, str(tmp_path / "s"), "conversion_id string, markdown string, error string")
    rows = lambda *x: spark.createDataFrame(x, "conversion_id string, markdown string, error string")
    a, b = "a" * 64, "b" * 64
    store.put(rows((a, None, "broken"), (b, "fine", None)))
    store.put(rows((a, None, "broken again")))
    assert not store.has(a) and store.has(b) and store.get(a).first()["error"] == "broken" and store.read().count() == 2
    store.put(rows((a, None, "broken"), (a, "mended", None), (b, None, "late")))
    assert store.has(a) and store.get(a).first()["markdown"] == "mended" and store.get(b).first()["markdown"] == "fine"
    store.put(rows((a, "other", None)))
    assert store.list().count() == 2 and store.get("c" * 64).count() == 0


def test_large_files_are_rows_with_an_error(spark, tmp_path):
    from paperloom.streaming.ingest import ingest

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "small.txt").write_text("ok")
    (inbox / "large.txt").write_text("x" * 5000)
    convert = lambda df: df.select("conversion_id", "path", F.decode("content", "UTF-8").alias("markdown"), F.lit(None).cast("string").alias("error"))
    store = S.ConversionStore(spark, str(tmp_path / "s"), "conversion_id string, path string, markdown string, error string")
    for k in range(2):
        ingest(spark, str(inbox), store, convert, str(tmp_path / f"check{k}"), max_bytes=1000).awaitTermination(120)
    made = {r["path"].rsplit("/", 1)[1]: (r["markdown"], r["error"]) for r in store.read().collect()}
    assert made == {"small.txt": ("ok", None), "large.txt": (None, "file-too-large")} and store.read().count() == 2
    plain = S.ConversionStore(spark, str(tmp_path / "p"), "conversion_id string, markdown string")
    with pytest.raises(Exception, match="no column for errors"):
        ingest(spark, str(inbox), plain, lambda df: convert(df).select("conversion_id", "markdown"), str(tmp_path / "check2"), max_bytes=1000).awaitTermination(120)


def test_convert_mixed_files(spark):
    from paperloom import engine

    docx = archive({"word/document.xml": f"<w:document {W_NS}><w:body><w:p><w:r><w:t>hello</w:t></w:r></w:p></w:body></w:document>"})
    files = [("/in/a.xlsx", build_xlsx([SHEET])), ("/in/b.xls", build_xls([SHEET])), ("/in/c.docx", docx), ("/in/d.html", b"<title>T</title><p>x</p>"), ("/in/e.pdf", b"%PDF"), ("/in/f.zip", b"PK"), ("/in/g.xlsx", b"junk"), ("/in/h.hwpx", b"junk")]
    frame = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    found = engine.convert(frame).persist()
    made = {r["path"]: r for r in found.collect()}
    assert len(made) == 8 and made["/in/a.xlsx"]["markdown"] == made["/in/b.xls"]["markdown"] and made["/in/a.xlsx"]["hidden_excluded"]["rows"] == 1
    assert made["/in/c.docx"]["markdown"] == "hello" and made["/in/d.html"]["markdown"] == "# T\n\nx"
    assert [made[f"/in/{x}"]["error"] for x in ("e.pdf", "f.zip")] == ["no-reader", "unsupported-format"]
    assert made["/in/g.xlsx"]["error"].startswith("BadZipFile") and made["/in/h.hwpx"]["error"].startswith("BadZipFile")
    assert engine.sections(found).where("path[0] = 'T'").count() == 1


def test_images_and_sinks(spark, tmp_path):
    from paperloom.sources import sinks

    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="media/one.PNG"/></Relationships>'
    drawing = '<w:p><w:r><w:drawing><wp:docPr xmlns:wp="w" descr="Alt"/><a:blip xmlns:a="a" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:embed="r1"/></w:drawing></w:r></w:p>'
    content = archive({"word/document.xml": f"<w:document {W_NS}><w:body>{drawing}</w:body></w:document>", "word/_rels/document.xml.rels": rels, "word/media/one.PNG": "data"})
    files = spark.createDataFrame([("/in/x.docx", bytearray(content)), ("/in/bad.docx", bytearray(b"junk"))], "path string, content binary")
    found = N.read_images(files, "docx")
    assert [(r["name"], r["alt"], bytes(r["data"])) for r in found.collect()] == [("img_001.png", "Alt", b"data")]
    assert "![Alt](img_001.png)" in N.read_text(files, "docx").where("path = '/in/x.docx'").first()["markdown"]
    assert [r["file"] for r in sinks.write_images(found, f"file://{tmp_path}").collect()] == ["x_images/img_001.png"]
    assert (tmp_path / "x_images" / "img_001.png").read_bytes() == b"data"
    texts = spark.createDataFrame([("/in/x.docx", "# é"), ("/in/y.docx", None)], "path string, markdown string")
    assert [tuple(r) for r in sinks.write_markdown(texts, str(tmp_path)).collect()] == [("x.md", 4)] and (tmp_path / "x.md").read_text() == "# é"


def test_order_of_a_locale(spark):
    from paperloom.operators.conversions import by_locale

    names = spark.createDataFrame([("나",), ("가",), ("b",), ("A",), ("다",), ("a",)], "name string")
    made = [r["name"] for r in by_locale(names, "name").collect()]
    assert [x for x in made if x in "가나다"] == ["가", "나", "다"] and made.index("b") > made.index("A") and made.index("b") > made.index("a")


def test_references_are_rewritten_once_and_by_whole_names(spark):
    from paperloom.operators import images as I

    links = F.create_map(*[F.lit(x) for x in ("a.png", "https://cdn/b.png", "b.png", "https://cdn/$1\\x)".replace(")", ""), "ba.png", "w")])
    cases = {
        "![x](./img/a.png) ![](a.png)![y](img/ba.png)": "![x](https://cdn/b.png) ![](https://cdn/b.png)![y](w)",
        "![x](b.png) [a.png](a.png) ![z](c.png)": "![x](https://cdn/$1\\x) [a.png](a.png) ![z](c.png)",
        "": "", "no ![open](a.png": "no ![open](a.png",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "md string").select("md", I.rewritten(F.col("md"), links).alias("out"))
    assert {r["md"]: r["out"] for r in frame.collect()} == cases
    assert spark.range(1).select(I.rewritten(F.lit(None).cast("string"), links).alias("x")).first()["x"] is None


def test_files_of_one_path_keep_their_own_results(spark):
    from paperloom import engine

    page = lambda t: bytearray(f"<title>{t}</title><p>{t}</p>".encode())
    sheet = lambda t: bytearray(build_xlsx([{**SHEET, "rows": [[t, "x"], [t, "y"]], "merges": [], "hidden_rows": [], "hidden_cols": [], "formats": {}}]))
    files = [("/a.html", page("one")), ("/a.html", page("two")), ("/a.html", page("one")), ("/b.xlsx", sheet("p")), ("/b.xlsx", sheet("q")), ("/b.xlsx", sheet("p")), ("/c.html", page("one")), (None, page("none"))]
    made = engine.convert(spark.createDataFrame(files, "path string, content binary")).collect()
    assert len(made) == len(files)
    told = sorted((r["path"], next(w for w in ("one", "two", "p |", "q |") if w in r["markdown"])) for r in made if r["path"])
    assert told == [("/a.html", "one"), ("/a.html", "one"), ("/a.html", "two"), ("/b.xlsx", "p |"), ("/b.xlsx", "p |"), ("/b.xlsx", "q |"), ("/c.html", "one")]
    assert [r["error"] for r in made if r["path"] is None] == ["unsupported-format"]
