"""Queries over tables in text and over sheets that are mostly gaps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import once
from ..operators import grid as G
from ..operators import html_tables as T
from .registry import query, table
from .table_queries import CELLS_SQL, MERGES_SQL, cells, merges

#: Tables inside cells of tables, to three levels, composed of an order's lines; some with a stray end, or one that never ends.
INNER = "CASE WHEN l_partkey % 3 = 0 THEN '<table><tr><td>' || l_returnflag || '</td><td>' || l_linestatus || '</td></tr></table>' ELSE '' END"
MIDDLE = f"CASE WHEN l_linenumber % 2 = 1 THEN '<TABLE><tr><th>q</th><th>' || cast(cast(l_quantity as int) as string) || '</th></tr><tr><td colspan=2>n' || cast(l_suppkey as string) || {INNER} || '</td></tr></TABLE>' ELSE '' END"
LINE = f"'<tr><td rowspan=1>' || cast(l_linenumber as string) || '<td><p>a</p><b>' || cast(l_partkey as string) || '</b>' || {MIDDLE} || ' end</td></tr>'"
AROUND = ("'x </table> y <td>' || CASE WHEN l_orderkey % 3 = 0 THEN '<table></table>' ELSE '' END || '<table>'", "'</table> after' || CASE WHEN l_orderkey % 7 = 0 THEN '<table><tr><td>open' ELSE '' END")


def nested(spark: SparkSession, d: str) -> DataFrame:
    """Lines are composed behind the shuffle, of the few columns that they are made of."""
    keys = ["l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(*keys, "l_quantity", "l_returnflag", "l_linestatus")).alias("_l"))
    own = re.sub(r"\b(l_\w+)", r"x.\1", LINE)
    lines = F.array_sort(F.expr(f"transform(_l, x -> struct({', '.join(f'x.{k}' for k in keys)}, {own} AS line))"))
    return rows.select("l_orderkey", F.concat(F.expr(AROUND[0]), F.array_join(F.transform(lines, lambda x: x["line"]), ""), F.expr(AROUND[1])).alias("text"))


@query("""
WITH t AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS row, CAST(l_linenumber AS VARCHAR) AS a,
  'a<br>**' || l_partkey || '** end' || CASE WHEN l_linenumber % 2 = 1 THEN '<br>(표 2×2)<br>q · ' || CAST(l_quantity AS INT) || '<br>n' || l_suppkey || CASE WHEN l_partkey % 3 = 0 THEN '<br>(표 1×2)<br>' || l_returnflag || ' · ' || l_linestatus ELSE '' END ELSE '' END AS b FROM lineitem)
SELECT l_orderkey, CAST(row AS INT) AS row, 0 AS col, a AS text FROM t UNION ALL SELECT l_orderkey, CAST(row AS INT), 1, b FROM t""")
def q_nested_tables(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the outermost tables, with what stands in tables inside them."""
    return T.tables(nested(spark, d), ["l_orderkey"]).select("l_orderkey", "row", "col", "text")


@query("""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS row, '| ' || l_linenumber || ' | a<br>**' || l_partkey || '** end' || CASE WHEN l_linenumber % 2 = 1 THEN '<br>(표 2×2)<br>q · ' || CAST(l_quantity AS INT) || '<br>n' || l_suppkey || CASE WHEN l_partkey % 3 = 0 THEN '<br>(표 1×2)<br>' || l_returnflag || ' · ' || l_linestatus ELSE '' END ELSE '' END || ' |' AS line FROM lineitem)
SELECT l_orderkey, 'x </table> y <td>' || CASE WHEN l_orderkey % 3 = 0 THEN '<table></table>' ELSE '' END || string_agg(line || CASE WHEN row = 0 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY row) || ' after' || CASE WHEN l_orderkey % 7 = 0 THEN '<table><tr><td>open' ELSE '' END AS text FROM t GROUP BY l_orderkey""")
def q_tables_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts with their HTML tables written as pipe tables; an empty table and one that never ends stay as they are."""
    return T.normalized(nested(spark, d), ["l_orderkey"])


CLIPPED_SQL = "clipped AS (SELECT m.sheet, r1, c1, least(r2, r) AS r2, least(c2, c) AS c2 FROM merges m JOIN size USING (sheet) WHERE r2 >= r1 AND c2 >= c1 AND r1 <= r AND c1 <= c)"


@query(f"WITH {CELLS_SQL}, {MERGES_SQL}, {CLIPPED_SQL} SELECT d.sheet, d.row, d.col, CASE WHEN m.r1 IS NULL THEN d.text WHEN d.row > m.r1 THEN '↑' WHEN d.col > m.c1 THEN '←' ELSE d.text END AS text FROM dense d LEFT JOIN clipped m ON m.sheet = d.sheet AND d.row BETWEEN m.r1 AND m.r2 AND d.col BETWEEN m.c1 AND m.c2")
def q_span_grid(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles from cells with spans alone: where each cell stands is found again from the rows above it."""
    own = cells(spark, d).select("sheet", F.struct("row", "col", "text").alias("cell"))
    every = own.unionByName(merges(spark, d).select("sheet", F.struct("r1", "c1", "r2", "c2").alias("merge")), allowMissingColumns=True)
    # a sheet is one row from here on: its positions are neither joined nor sorted
    sheets = every.groupBy("sheet").agg(F.collect_list("cell").alias("cells"), F.collect_list("merge").alias("merges")).where(F.size("cells") > 0)
    rows = sheets.select("sheet", G.spanned_lines(G.dense_lines(F.col("cells")), F.col("merges")).alias("rows"))
    return T.positions(rows.select("sheet", once(F.col("rows"), T.rectangle).alias("lines")), ["sheet"], "lines")


@query(f"""
WITH {CELLS_SQL}, {MERGES_SQL},
every AS (SELECT * FROM raw UNION ALL SELECT DISTINCT sheet, 1000000 + sheet, 16000, 'far' FROM raw),
sheets AS (SELECT DISTINCT sheet FROM raw),
hr AS (SELECT DISTINCT sheet, row FROM every WHERE row % 7 = 0), hc AS (SELECT DISTINCT sheet, col FROM every WHERE col % 4 = 2),
vr AS (SELECT * FROM (SELECT sheet, row, row_number() OVER (PARTITION BY sheet ORDER BY row) - 1 AS nr FROM (SELECT sheet, unnest(range(400)) AS row FROM sheets) ANTI JOIN hr USING (sheet, row)) WHERE nr < 200),
vc AS (SELECT * FROM (SELECT sheet, col, row_number() OVER (PARTITION BY sheet ORDER BY col) - 1 AS nc FROM (SELECT sheet, unnest(range(60)) AS col FROM sheets) ANTI JOIN hc USING (sheet, col)) WHERE nc < 20),
covered AS (SELECT m.sheet, m.r1, m.c1, nr, nc, min(nr) OVER (PARTITION BY m.sheet, m.r1, m.c1) AS a, min(nc) OVER (PARTITION BY m.sheet, m.r1, m.c1) AS b FROM merges m JOIN vr ON vr.sheet = m.sheet AND vr.row BETWEEN m.r1 AND m.r2 JOIN vc ON vc.sheet = m.sheet AND vc.col BETWEEN m.c1 AND m.c2),
grid AS (SELECT vr.sheet, vr.nr, vc.nc, CASE WHEN v.sheet IS NULL THEN coalesce(e.text, '') WHEN v.nr > a THEN '↑' WHEN v.nc > b THEN '←' ELSE coalesce(o.text, '') END AS text
  FROM vr JOIN vc USING (sheet) LEFT JOIN every e ON e.sheet = vr.sheet AND e.row = vr.row AND e.col = vc.col LEFT JOIN covered v ON v.sheet = vr.sheet AND v.nr = vr.nr AND v.nc = vc.nc LEFT JOIN every o ON o.sheet = v.sheet AND o.row = v.r1 AND o.col = v.c1),
lines AS (SELECT sheet, nr, '| ' || string_agg(replace(text, '|', '\\|'), ' | ' ORDER BY nc) || ' |' AS line, repeat('| --- ', count(*)) || '|' AS rule FROM grid GROUP BY 1, 2),
h AS (SELECT sheet, (SELECT count(*) FROM hr WHERE hr.sheet = s.sheet AND hr.row <= 1000000 + s.sheet) AS hidden_rows FROM sheets s)
SELECT sheet, hidden_rows, md5(string_agg(line || CASE WHEN nr = 0 THEN chr(10) || rule ELSE '' END, chr(10) ORDER BY nr)) AS digest FROM lines JOIN h USING (sheet) GROUP BY 1, 2""")
def q_sparse_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Sheets with a cell far off: their first 200 rows and 20 columns that show, with merges, as Markdown."""
    near = cells(spark, d)
    far = near.select("sheet").distinct().selectExpr("sheet", "1000000 + sheet AS row", "16000 AS col", "'far' AS text")
    flagged = near.unionByName(far).withColumns({"row_hidden": F.col("row") % 7 == 0, "col_hidden": F.col("col") % 4 == 2})
    shown, sizes = G.sparse_visible(flagged, merges(spark, d), ["sheet"], 200, 20)
    return G.sparse_tables(shown, sizes, ["sheet"]).join(sizes, "sheet").select("sheet", "hidden_rows", F.md5("markdown").alias("digest"))
