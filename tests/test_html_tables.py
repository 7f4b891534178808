"""Nested and spanned tables against a stack machine and a plain grid, on random soups of tags."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.functions import tables as one_text
from paperloom.operators import html_tables as T
from paperloom.plans import nested_queries

TOKEN = re.compile(T.TAG)


def clean(html):
    x = re.sub(r"(?i)</(?:p|div|h[1-6]|ul|ol|li|blockquote|pre)\s*>|<br\s*/?>", "\n", re.sub(r"\s+", " ", html).strip())
    x = re.sub(r"</?[a-zA-Z][^>]*>", "", re.sub(r"(?i)</?(?:em|i)(?:\s[^>]*)?>", "*", re.sub(r"(?i)</?(?:strong|b)(?:\s[^>]*)?>", "**", x)))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = x.replace(a, b)
    return re.sub(r"\s*\n\s*", "\n", x).strip().replace("\n", "<br>")


def attribute(tag, name, most):
    m = re.search(rf"(?i)\s{name}\s*=\s*[\"']?\s*(\d{{1,9}})", tag)
    return max(1, min(most, int(m[1]))) if m else 1


def outermost(text):
    """Tables as lists of rows of [own text, nested tables, spans], by a stack; those that are never closed are left out."""
    found, stack, at = [], [], 0
    for m in [*TOKEN.finditer(text), None]:
        piece = text[at : m.start() if m else len(text)]
        if stack and stack[-1]["cell"] is not None:
            stack[-1]["cell"]["own"] += piece
        if m is None:
            return found
        at, tag = m.end(), m[0]
        name, closing = re.match(r"</?([a-zA-Z]+)", tag)[1].lower(), tag.startswith("</")
        if name == "table":
            if not closing:
                stack.append({"rows": [], "cell": None})
            elif stack:
                table = stack.pop()
                if not stack:
                    found.append(table["rows"])
                elif stack[-1]["cell"] is not None:
                    stack[-1]["cell"]["tables"].append(table["rows"])
        elif stack:
            top = stack[-1]
            top["cell"] = None
            if not closing and name == "tr":
                top["rows"].append([])
            elif not closing:
                if not top["rows"]:
                    top["rows"].append([])
                top["cell"] = {"own": "", "tables": [], "w": attribute(tag, "colspan", 1000), "h": attribute(tag, "rowspan", 65534)}
                top["rows"][-1].append(top["cell"])
    return found


def text_of(cell, depth=0):
    parts = [clean(cell["own"])]
    for rows in cell["tables"]:
        size = f"(표 {len(rows)}×{len(rows[0]) if rows else 0})"
        if depth >= 5:
            parts.append(size + " 깊이 초과 생략")
        else:
            parts.append("<br>".join([size, *[" · ".join(text_of(c, depth + 1) for c in row) for row in rows]]))
    return "<br>".join(p for p in parts if p)


def rectangle(rows):
    """Columns that a cell above covers are marked when a row gets there."""
    left, out = {}, []
    for row in rows:
        line, col = [], 0

        def drain(line=line):
            nonlocal col
            while left.get(col, 0) > 0:
                left[col] -= 1
                line.append("↑")
                col += 1

        for text, w, h in row:
            drain()
            line.extend([text] + ["←"] * (w - 1))
            if h > 1:
                left.update({c: h - 1 for c in range(col, col + w)})
            col += w
        drain()
        out.append(line)
    width = max(map(len, out), default=0)
    return [line + [""] * (width - len(line)) for line in out]


def soup(rng):
    """Mostly nested tables, with stray, missing and repeated tags."""

    def table(depth):
        out = ["<TABLE border='1'>" if rng.random() < 0.3 else "<table>"]
        for _ in range(rng.randint(0, 3)):
            out.append("<tr>")
            for _ in range(rng.randint(0, 3)):
                spans = rng.choice(["", "", " colspan=2", ' rowspan="2"', " ROWSPAN='3' colspan=\"2\"", " colspan=0", " colspan=x"])
                out.append(f"<{rng.choice(['td', 'th', 'TD'])}{spans}>")
                out.append(rng.choice(["", " a ", "b&amp;<b>c</b>", "<p>one</p><p>two</p>", "x|y", "line\nbreak<br/>", "<i>z</i> ", "<thead>"]))
                if depth < 8 and rng.random() < (0.75 if depth < 7 else 0.2):
                    out.append(table(depth + 1))
                    out.append(rng.choice(["", "after"]))
                out.append(rng.choice(["</td>", "</td>", ""]))
            out.append(rng.choice(["</tr>", "</tr>", "", " stray "]))
        out.append("</table>")
        return "".join(out)

    whole = "".join(rng.choice(["text ", "\n\n", "</table>", "<td>", "</tr>"]) + table(1) for _ in range(rng.randint(0, 2)))
    if rng.random() < 0.3:  # tags get lost
        whole = "".join(p for p in re.split(f"({T.TAG[4:]})", whole) if rng.random() > 0.04)
    return whole + rng.choice(["", "tail", "<table><tr><td>never closed"])


@pytest.fixture(scope="module")
def soups(spark):
    rng = random.Random(4)
    rows = [(k, soup(rng), "extra") for k in range(150)] + [(1000, None, None), (1001, "", "x"), (1002, "no table", None), (1003, "<table></table>", None), (1004, "<table><tr></tr><td>loose", None)]
    return spark.createDataFrame(rows, "doc long, text string, row string").repartition(3)


def test_cells_are_those_of_the_stack(soups):
    found = {}
    for r in T.top_cells(T.placed_tags(soups, ["doc"], "text"), ["doc"]).orderBy("doc", "top", "row", "cell").collect():
        rows = found.setdefault(r["doc"], {}).setdefault(r["top"], {}).setdefault(r["row"], [])
        if r["cell"] >= 0:
            rows.append((r["text"], r["col_span"], r["row_span"]))
    deep = 0
    for r in soups.collect():
        expected = [[[(text_of(c), c["w"], c["h"]) for c in row] for row in rows] for rows in outermost(r["text"] or "")]
        deep += "깊이" in str(expected)
        assert [[*t.values()] for t in found.get(r["doc"], {}).values()] == [t for t in expected if t]
    assert deep


def test_grids_are_rectangles_of_the_stack(soups):
    found = {}
    for r in T.tables(soups.drop("row"), ["doc"]).orderBy("doc", "top", "row", "col").collect():
        found.setdefault(r["doc"], {}).setdefault(r["top"], {}).setdefault(r["row"], []).append(r["text"])
    for r in soups.collect():
        expected = [rectangle([[(text_of(c), c["w"], c["h"]) for c in row] for row in rows]) for rows in outermost(r["text"] or "")]
        assert [[*t.values()] for t in found.get(r["doc"], {}).values()] == [[line for line in t if line] for t in expected if any(t)]


def test_random_spans(spark):
    rng = random.Random(9)
    tables = [[[(f"{i}.{j}", rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 4])) for j in range(rng.randint(0, 4))] for i in range(rng.randint(1, 6))] for _ in range(80)]
    rows = [(k, i, j, *c) for k, t in enumerate(tables) for i, row in enumerate(t) for j, c in enumerate([(None, None, None), *row], -1)]
    found = {}
    for r in T.grids(spark.createDataFrame(rows, "t long, row long, cell long, text string, col_span int, row_span int").repartition(4), ["t"]).orderBy("t", "row", "col").collect():
        found.setdefault(r["t"], {}).setdefault(r["row"], []).append(r["text"])
    assert {k: [*t.values()] for k, t in found.items()} == {k: [x for x in rectangle(t) if x] for k, t in enumerate(tables) if any(rectangle(t))}


def test_text_around_tables_stays(spark):
    text = "before <table><tr><td rowspan=2>a|b</td><td>c<table><tr><td>d</td><td>e</td></tr></table></td></tr><tr><td>f</td></tr></table> after </table>\n<td>x <table>open"
    made = T.normalized(spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc long, text string"), ["doc"])
    assert {r["doc"]: r["text"] for r in made.collect()} == {1: "before | a\\|b | c<br>(표 1×2)<br>d · e |\n| --- | --- |\n| ↑ | f | after </table>\n<td>x <table>open", 2: None, 3: "plain"}


def test_one_shuffle_by_document(spark):
    docs = spark.range(10).selectExpr("id AS doc", "'<table><tr><td>x<table><tr><td>y</td></tr></table></td></tr></table>' AS text").repartition(3, "text")
    made = T.tables(docs, ["doc"])
    assert [r["text"] for r in made.collect()] == ["x<br>(표 1×1)<br>y"] * 10
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # cells of outermost tables and of those inside read one and the same shuffle
    assert plan.count("Exchange hashpartitioning(doc") - plan.count("ReusedExchange") <= 1


def test_a_text_is_one_row_all_along(spark):
    """No row a tag, no window, no shuffle and no second reading of the texts."""
    docs = spark.range(10).selectExpr("id AS doc", "'<table><tr><td>x<table><tr><td>y</td></tr></table></td></tr></table>' AS text")
    for made in (T.tables(docs, ["doc"]), T.normalized(docs, ["doc"])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan and "Aggregate(" not in plan


def test_marks_in_a_text_stay(spark):
    """Control characters of the text itself, also inside tables, and tags that stand in other tags."""
    own = "".join(T.MARKS) + T.ESCAPE + "ay"
    text = f"{own}<table><tr><td title='<table>'>{own}&lt;td&gt;<table><tr><td>{own}&lt;tr&gt;{own}</table></td><td>{T.TABLE}2</td></tr></table>{own}</table>{own}"
    cell = f"'>{own}<td><br>(표 1×1)<br>{own}<tr>{own}"
    docs = spark.createDataFrame([(1, text), (2, f"{own}<table>{own}")], "doc long, text string")
    assert [(r["col"], r["text"]) for r in T.tables(docs, ["doc"]).orderBy("col").collect()] == [(0, cell), (1, f"{T.TABLE}2")]
    made = {r["doc"]: r["text"] for r in T.normalized(docs, ["doc"]).collect()}
    assert made == {1: f"{own}| {cell} | {T.TABLE}2 |\n| --- | --- |{own}</table>{own}", 2: f"{own}<table>{own}"}


def test_depths_in_stretches(spark):
    rng = random.Random(3)
    rows = [([rng.choice(x) for _ in range(n)],) for n in (0, 1, 5, T.STRETCH, T.STRETCH + 1, 3 * T.STRETCH, 3000) for x in ((1, -1), (1, 1, -1), (1, -1, -1))]
    for r in spark.createDataFrame(rows, "steps array<int>").select("steps", T.depths(F.col("steps")).alias("found")).collect():
        expected = [0]
        for s in r["steps"]:
            expected.append(max(0, expected[-1] + s))
        assert r["found"] == expected


def test_texts_with_tables_are_those_of_the_stack(soups):
    """Whole texts: pipe tables where tables were, all else as it was."""

    def written(text):
        """By the places at which outermost tables begin and end."""
        out, depth, begin, at = [], 0, 0, 0
        for m in TOKEN.finditer(text):
            if m[0].lower().startswith("<table"):
                begin = begin if depth else m.start()
                depth += 1
            elif m[0].lower().startswith("</table") and depth:
                depth -= 1
                if not depth:
                    lines = rectangle([[(text_of(c), c["w"], c["h"]) for c in row] for row in outermost(text[begin : m.end()])[0]])
                    if any(lines):
                        cells = [[re.sub(r"^(?:<br>)+|(?:<br>)+\Z", "", c.strip(" ")).replace("|", "\\|") for c in line] for line in lines]
                        cells.insert(1, ["---"] * len(cells[0]))
                        out += [text[at:begin], "\n".join(f"| {' | '.join(line)} |" for line in cells)]
                        at = m.end()
        return "".join([*out, text[at:]])

    found = {r["doc"]: r["text"] for r in T.normalized(soups.select("doc", "text"), ["doc"]).collect()}
    rows = soups.collect()
    assert len(found) == len(rows) and sum("| ---" in (x or "") for x in found.values()) > 50
    for r in rows:
        assert found[r["doc"]] == (None if r["text"] is None else written(r["text"])), r["text"]


def test_a_text_is_resolved_once(spark, sf):
    """One call a text and nothing folded beside it; what a query's shuffle carries are columns, not the lines made of them."""
    docs = spark.range(10).selectExpr("id AS doc", "'<table><tr><td>x</td></tr></table>' AS text")
    for made, name in ((T.normalized(docs, ["doc"]), "normalized_text("), (T.tables(docs, ["doc"]), "rectangles_of(")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"ArrowEvalPython \[" + re.escape(name), plan)) == 1 and "lambdafunction" not in plan
    plan = nested_queries.nested(spark, sf)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning(l_orderkey", 1)[1]
    assert "l_partkey" in below and "rowspan" not in below


def test_markup_in_one_pass_is_that_of_one_after_the_other():
    rng = random.Random(5)
    bits = ["<", "</", ">", "b", "p", " ", "\n", "<b>", "</p>", "<br/>", "<i x>", "&lt;", "&amp;lt;", "<span>", "<3>", "a", "\t", "  ", "strong", "<!"]
    for _ in range(20_000):
        x = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert one_text.inline(x) == clean(x), x


def test_deep_tables_and_many_cells():
    deep = "<table><tr><td>x" * 5000 + "</td></tr></table>" * 5000
    assert one_text.normalized(deep).endswith("(표 1×1) 깊이 초과 생략 |\n| --- |")
    assert one_text.normalized(deep + "<table>") == one_text.normalized(deep) + "<table>" and one_text.normalized("<table>" + deep) == "<table>" + deep
    many = "<table>" + "<tr>" + "<td>a</td>" * 1000 + "<td rowspan=70000 colspan=9999>b</table>"
    assert [[c[1:] for c in row][-1] for row in one_text.tables(many)[0]] == [(1000, 65534)]
    assert one_text.normalized(None) is None and one_text.normalized("") == "" and one_text.tables(None) == []
