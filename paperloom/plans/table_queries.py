"""Queries over grids, stores, images and web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import grid as G
from ..operators import images as I
from ..operators import metrics as M
from ..operators import store as S
from ..sources import html_pages as P
from .registry import query, table

#: Sheets of cells composed from line items, a sheet for each supplier: the row and column come from keys, one cell a position.
CELLS_SQL = """
raw AS (SELECT CAST(l_suppkey AS INT) AS sheet, CAST(l_orderkey % 97 AS INT) AS row, CAST(l_partkey % 13 AS INT) AS col, min(CASE WHEN l_quantity > 30 THEN l_returnflag || '|' || l_linestatus ELSE '' END) AS text FROM lineitem GROUP BY 1, 2, 3),
size AS (SELECT sheet, max(row) AS r, max(col) AS c FROM raw GROUP BY sheet),
dense AS (SELECT p.sheet, p.row, p.col, coalesce(raw.text, '') AS text FROM (SELECT sheet, row, unnest(range(c + 1)) AS col FROM (SELECT sheet, c, unnest(range(r + 1)) AS row FROM size)) p LEFT JOIN raw USING (sheet, row, col))
"""
MERGES_SQL = """merges AS (SELECT s AS sheet, k * 6 AS r1, s % 4 AS c1, k * 6 + s % 3 AS r2, s % 4 + k % 3 - CASE WHEN k = 5 THEN 3 ELSE 0 END AS c2 FROM (SELECT CAST(s_suppkey AS INT) AS s FROM supplier), (SELECT unnest(range(6)) AS k))"""
FLAGGED_SQL = "flagged AS (SELECT *, row % 7 = 0 AS rh, col % 4 = 2 AS ch FROM dense)"
MAPS_SQL = """
rmap AS (SELECT sheet, row, row_number() OVER (PARTITION BY sheet ORDER BY row) - 1 AS nr FROM (SELECT DISTINCT sheet, row FROM flagged WHERE NOT rh)),
cmap AS (SELECT sheet, col, row_number() OVER (PARTITION BY sheet ORDER BY col) - 1 AS nc FROM (SELECT DISTINCT sheet, col FROM flagged WHERE NOT ch))
"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").selectExpr("cast(l_suppkey as int) AS sheet", "cast(l_orderkey % 97 as int) AS row", "cast(l_partkey % 13 as int) AS col", "CASE WHEN l_quantity > 30 THEN l_returnflag || '|' || l_linestatus ELSE '' END AS text")
    return t.groupBy("sheet", "row", "col").agg(F.min("text").alias("text"))


def merges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").selectExpr("cast(s_suppkey as int) AS s", "explode(sequence(0, 5)) AS k").selectExpr("s AS sheet", "k * 6 AS r1", "s % 4 AS c1", "k * 6 + s % 3 AS r2", "s % 4 + k % 3 - CASE WHEN k = 5 THEN 3 ELSE 0 END AS c2")


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return G.dense(cells(spark, d), ["sheet"]).withColumns({"row_hidden": F.col("row") % 7 == 0, "col_hidden": F.col("col") % 4 == 2})


@query(f"WITH {CELLS_SQL} SELECT sheet, row, col, text FROM dense")
def q_sheet_dense(spark: SparkSession, d: str) -> DataFrame:
    return G.dense(cells(spark, d), ["sheet"])


@query(f"WITH {CELLS_SQL}, b AS (SELECT sheet, max(row) AS r, max(col) AS c FROM raw WHERE text <> '' GROUP BY sheet) SELECT sheet, row, col, text FROM (SELECT dense.*, r, c FROM dense JOIN b USING (sheet)) WHERE row <= r AND col <= c AND row < 5000 AND col < 200")
def q_sheet_trim(spark: SparkSession, d: str) -> DataFrame:
    return G.capped(G.trimmed(G.dense(cells(spark, d), ["sheet"]), ["sheet"]))


@query(f"WITH {CELLS_SQL}, {MERGES_SQL}, x AS (SELECT sheet, row AS r, col AS c FROM raw WHERE text <> '' UNION ALL SELECT sheet, r2, c2 FROM merges) SELECT sheet, max(r) AS last_row, max(c) AS last_col FROM x GROUP BY sheet")
def q_sheet_bounds(spark: SparkSession, d: str) -> DataFrame:
    return G.content_bounds(cells(spark, d), ["sheet"], merges(spark, d))


@query(f"WITH {CELLS_SQL}, {MERGES_SQL} SELECT d.sheet, d.row, d.col, CASE WHEN m.r1 IS NULL THEN d.text WHEN d.row > m.r1 THEN '↑' WHEN d.col > m.c1 THEN '←' ELSE d.text END AS text FROM dense d LEFT JOIN merges m ON m.sheet = d.sheet AND m.r2 >= m.r1 AND m.c2 >= m.c1 AND d.row BETWEEN m.r1 AND m.r2 AND d.col BETWEEN m.c1 AND m.c2")
def q_merge_arrows(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_arrows(G.dense(cells(spark, d), ["sheet"]), merges(spark, d), ["sheet"])


@query(f"WITH {MERGES_SQL} SELECT sheet, row, unnest(range(c1, c2 + 1)) AS col, r1, c1, c2 - c1 + 1 AS col_span, r2 - r1 + 1 AS row_span FROM (SELECT *, unnest(range(r1, r2 + 1)) AS row FROM merges WHERE r2 >= r1 AND c2 >= c1)")
def q_merge_cells(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_cells(merges(spark, d)).select("sheet", "row", "col", "r1", "c1", "col_span", "row_span")


@query(f"""WITH {CELLS_SQL}, {MERGES_SQL}, {FLAGGED_SQL}, {MAPS_SQL},
each AS (SELECT m.sheet, m.r1, m.c1, nr, nc FROM merges m JOIN rmap r ON r.sheet = m.sheet AND r.row BETWEEN m.r1 AND m.r2 JOIN cmap c ON c.sheet = m.sheet AND c.col BETWEEN m.c1 AND m.c2),
spans AS (SELECT e.sheet, r1, c1, min(nr) AS nr, min(nc) AS nc, count(DISTINCT nr) AS row_span, count(DISTINCT nc) AS col_span FROM each e GROUP BY 1, 2, 3),
anchors AS (SELECT s.sheet, s.nr, s.nc, s.row_span, s.col_span, coalesce(d.text, '') AS moved FROM spans s LEFT JOIN dense d ON d.sheet = s.sheet AND d.row = s.r1 AND d.col = s.c1)
SELECT f.sheet, r.nr AS row, c.nc AS col, coalesce(a.moved, f.text) AS text, coalesce(a.row_span, 1) AS row_span, coalesce(a.col_span, 1) AS col_span, a.moved IS NULL AND e.sheet IS NOT NULL AS covered
FROM flagged f JOIN rmap r USING (sheet, row) JOIN cmap c USING (sheet, col) LEFT JOIN anchors a ON a.sheet = f.sheet AND a.nr = r.nr AND a.nc = c.nc LEFT JOIN (SELECT DISTINCT sheet, nr, nc FROM each) e ON e.sheet = f.sheet AND e.nr = r.nr AND e.nc = c.nc""")
def q_hidden_projection(spark: SparkSession, d: str) -> DataFrame:
    return G.project_visible(flagged(spark, d), ["sheet"], merges(spark, d))


LINK = "CASE WHEN text <> '' THEN 'https://h/' || {row} || '/' || {col} END"


@query(f"""WITH {CELLS_SQL}, {MERGES_SQL}, {FLAGGED_SQL}, {MAPS_SQL},
each AS (SELECT m.sheet, m.r1, m.c1, nr, nc FROM merges m JOIN rmap r ON r.sheet = m.sheet AND r.row BETWEEN m.r1 AND m.r2 JOIN cmap c ON c.sheet = m.sheet AND c.col BETWEEN m.c1 AND m.c2),
spans AS (SELECT sheet, r1, c1, min(nr) AS nr, min(nc) AS nc FROM each GROUP BY 1, 2, 3),
anchors AS (SELECT s.sheet, s.nr, s.nc, {LINK.format(row="s.r1", col="s.c1")} AS link FROM spans s LEFT JOIN dense d ON d.sheet = s.sheet AND d.row = s.r1 AND d.col = s.c1)
SELECT * FROM (SELECT f.sheet, r.nr AS row, c.nc AS col, CASE WHEN a.sheet IS NOT NULL THEN a.link ELSE {LINK.format(row="f.row", col="f.col")} END AS href
  FROM flagged f JOIN rmap r USING (sheet, row) JOIN cmap c USING (sheet, col) LEFT JOIN anchors a ON a.sheet = f.sheet AND a.nr = r.nr AND a.nc = c.nc) WHERE href IS NOT NULL""")
def q_hidden_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of what shows: those of hidden rows and columns go, that of a merge moves with its text."""
    linked = flagged(spark, d).withColumn("href", F.expr(LINK.format(row="row", col="col")))
    return G.project_visible(linked, ["sheet"], merges(spark, d)).where("href IS NOT NULL").select("sheet", "row", "col", "href")


@query(f"WITH {CELLS_SQL}, {FLAGGED_SQL} SELECT sheet, count(DISTINCT CASE WHEN rh THEN row END) AS hidden_rows, count(DISTINCT CASE WHEN ch THEN col END) AS hidden_cols FROM flagged GROUP BY sheet")
def q_hidden_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.hidden_counts(flagged(spark, d), ["sheet"])


@query("SELECT DISTINCT p_brand, unnest(range(p_size, p_size + p_partkey % 3 + 1)) - 1 AS col FROM part")
def q_hidden_columns(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr("p_brand", "cast(p_size as bigint) AS min", "p_size + p_partkey % 3 AS max")
    return G.hidden_columns(t, ["p_brand"])


@query(f"""WITH {CELLS_SQL}, l AS (SELECT sheet, row, '| ' || string_agg(replace(text, '|', '\\|'), ' | ' ORDER BY col) || ' |' AS line, '| ' || string_agg('---', ' | ' ORDER BY col) || ' |' AS rule FROM dense GROUP BY sheet, row)
SELECT sheet, string_agg(CASE WHEN row = 0 THEN line || chr(10) || rule ELSE line END, chr(10) ORDER BY row) AS markdown FROM l GROUP BY sheet""")
def q_gfm_table(spark: SparkSession, d: str) -> DataFrame:
    return G.pipe_tables(G.dense(cells(spark, d), ["sheet"]), ["sheet"])


@query("SELECT l_orderkey, l_linenumber, l_partkey AS string_index, coalesce(p_name, '') AS text FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10")
def q_shared_strings(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").selectExpr("1 AS book", "l_orderkey", "l_linenumber", "l_partkey AS string_index")
    strings = table(spark, d, "part").where("p_size > 10").selectExpr("1 AS book", "p_partkey AS string_index", "p_name AS string")
    return G.shared_strings(t, strings, ["book"]).drop("book")


@query("SELECT o_orderkey, CASE WHEN s.n_nationkey IS NULL THEN 0 ELSE n_nationkey % 12 END AS format_id, r.r_name AS code FROM (SELECT o_orderkey, o_custkey % 40 AS style FROM orders) o LEFT JOIN nation s ON s.n_nationkey = o.style LEFT JOIN region r ON r.r_regionkey = CASE WHEN s.n_nationkey IS NULL THEN 0 ELSE n_nationkey % 12 END")
def q_style_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").selectExpr("1 AS book", "o_orderkey", "cast(o_custkey % 40 as int) AS style")
    styles = table(spark, d, "nation").selectExpr("1 AS book", "n_nationkey AS style", "n_nationkey % 12 AS format_id")
    formats = table(spark, d, "region").selectExpr("1 AS book", "r_regionkey AS format_id", "r_name AS code")
    return G.style_formats(t, styles, formats, ["book"]).select("o_orderkey", "format_id", "code")


@query(f"""WITH {CELLS_SQL}, a AS (SELECT sheet, row, col, CASE WHEN row % 5 = 0 AND col = 1 THEN '←' ELSE text END AS t FROM dense), b AS (SELECT sheet, row, col, CASE WHEN row % 5 = 0 AND col = 1 AND row % 2 = 0 THEN '←' WHEN row % 11 = 3 THEN 'x' ELSE text END AS t FROM dense WHERE row <> 17)
SELECT sheet, count(*) FILTER (coalesce(e NOT IN ('←', '↑'), true) AND coalesce(e = g, false)) AS cells_ok, count(*) FILTER (coalesce(e NOT IN ('←', '↑'), true) AND NOT coalesce(e = g, false)) AS cells_diff,
  count(*) FILTER (e IN ('←', '↑') AND coalesce(e = g, false)) AS arrows_ok, count(*) FILTER (e IN ('←', '↑') AND NOT coalesce(e = g, false)) AS arrows_diff
FROM (SELECT sheet, a.t AS e, b.t AS g FROM a FULL JOIN b USING (sheet, row, col)) GROUP BY sheet""")
def q_table_verify(spark: SparkSession, d: str) -> DataFrame:
    t = G.dense(cells(spark, d), ["sheet"])
    a = t.withColumn("text", F.expr("CASE WHEN row % 5 = 0 AND col = 1 THEN '←' ELSE text END"))
    b = t.where("row <> 17").withColumn("text", F.expr("CASE WHEN row % 5 = 0 AND col = 1 AND row % 2 = 0 THEN '←' WHEN row % 11 = 3 THEN 'x' ELSE text END"))
    return M.verify_grids(a, b, ["sheet"])


@query("SELECT doc_id, sha256(coalesce(text, '')) AS plain, sha256(CASE WHEN doc_id % 2 = 0 THEN 'opt:includeHidden ' ELSE '' END || coalesce(text, '')) AS id, substr(sha256(CASE WHEN doc_id % 2 = 0 THEN 'opt:includeHidden ' ELSE '' END || coalesce(text, '')), 1, 2) AS shard, true AS valid FROM documents")
def q_conversion_id(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("doc_id", S.conversion_id(F.col("text"), F.lit(False)).alias("plain"), S.conversion_id(F.col("text"), F.col("doc_id") % 2 == 0).alias("id"))
    return t.select("*", S.shard(F.col("id")).alias("shard"), S.is_conversion_id(F.col("id")).alias("valid"))


@query("SELECT doc_id, h AS conversion_id, row_number() OVER w > 1 AS hit, first_value('d' || doc_id || '.html') OVER w AS stored_name FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) WINDOW w AS (PARTITION BY h ORDER BY doc_id)")
def q_cache_first_wins(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", S.conversion_id(F.coalesce("text", F.lit("")), F.lit(False)).alias("conversion_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".html")).alias("name"))
    return S.cached(t, order=["doc_id"]).drop("name")


@query("WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS id FROM documents), s AS (SELECT id FROM t WHERE doc_id % 3 = 0) SELECT 'hit' AS kind, count(*) AS n FROM t WHERE id IN (SELECT id FROM s) UNION ALL SELECT 'miss', count(DISTINCT id) FROM t WHERE id NOT IN (SELECT id FROM s)")
def q_cache_hit_miss(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", S.conversion_id(F.coalesce("text", F.lit("")), F.lit(False)).alias("conversion_id"))
    stored = t.where("doc_id % 3 = 0")
    one = lambda df, k: df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return one(S.hits(t, stored), "hit").unionByName(one(S.misses(t, stored), "miss"))


FILES = "concat('r', cast(o_custkey % 5 as string), '/n', cast(o_custkey % 25 as string), '/f', cast(o_orderkey % 300 as string), '.pdf')"


@query(f"WITH e AS (SELECT DISTINCT {FILES} AS path FROM orders WHERE o_orderkey % 4 = 0) SELECT path, min(o_orderkey) AS o_orderkey FROM (SELECT {FILES} AS path, o_orderkey FROM orders) WHERE path NOT IN (SELECT path FROM e) GROUP BY path")
def q_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").selectExpr(f"{FILES} AS path", "o_orderkey")
    return S.new_paths(t.where("o_orderkey % 4 = 0"), t, "o_orderkey")


@query(f"WITH p AS (SELECT {FILES} AS path FROM orders) SELECT split_part(path, '/', 1) AS folder, count(*) AS files FROM p GROUP BY 1 UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), count(*) FROM p GROUP BY 1")
def q_folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    return M.folder_rollup(table(spark, d, "orders").selectExpr(f"{FILES} AS path"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def q_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.status_counts(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"))


MD = "concat('See ![', CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_brand END, '](./doc_images/img_', cast(p_partkey as string), '.png) end')"


@query(f"""WITH t AS (SELECT p_partkey, {MD} AS md, sha256(p_name) AS id FROM part)
SELECT p_partkey, replace(md, './doc_images/', 'conv://' || id || '/images/') AS refs, CASE WHEN p_partkey % 3 = 0 THEN 'See _[이미지]_ end' ELSE regexp_replace(md, '!\\[([^\\]]*)\\]\\([^)]*\\)', '_[이미지: \\1]_') END AS omitted,
  CASE WHEN p_partkey % 2 = 0 THEN replace(md, './doc_images/img_' || p_partkey || '.png', 'https://cdn/' || p_partkey) ELSE md END AS urls, 'data:image/png;base64,' || base64(encode(p_name)) AS inline, p_size > 30 AS refused, replace('![](a.png)', '](a.png)', '](./' || p_brand || '/a.png)') AS prefixed FROM t JOIN part USING (p_partkey)""")
def q_image_modes(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import prefix_image_refs

    t = table(spark, d, "part").withColumn("md", F.expr(MD)).withColumn("id", F.sha2("p_name", 256))
    name = F.concat(F.lit("img_"), F.col("p_partkey").cast("string"), F.lit(".png"))
    links = F.create_map(F.when(F.col("p_partkey") % 2 == 0, name).otherwise("other.png"), F.concat(F.lit("https://cdn/"), F.col("p_partkey").cast("string")))
    sizes = F.array(F.struct(name.alias("name"), (F.col("p_size") * 1024 + 1).alias("size")), F.struct(F.lit("b").alias("name"), F.lit(5).alias("size")))
    return t.select(
        "p_partkey", I.as_refs(F.col("md"), F.col("id")).alias("refs"), I.omitted(F.col("md")).alias("omitted"), I.rewritten(F.col("md"), links).alias("urls"),
        I.data_uri(F.lit("image/png"), F.col("p_name").cast("binary")).alias("inline"), (F.size(I.too_large(sizes, 31)) > 0).alias("refused"),
        prefix_image_refs(F.lit("![](a.png)"), F.array(F.lit("a.png")), F.col("p_brand")).alias("prefixed"),
    )


_KEY = b"paperloom-test-key"
_INNER, _OUTER = (p.hex() for p in I._pads(_KEY))


@query(f"""WITH t AS (SELECT p_partkey, sha256(p_name) AS id, p_brand AS name, 1700000000 + p_size AS exp FROM part),
s AS (SELECT *, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(id || ':' || name || ':' || exp)))) AS sig FROM t)
SELECT p_partkey, sig, 'https://h/v1/images/' || id || '/' || name || '?exp=' || exp || '&sig=' || sig AS url, CASE WHEN exp <= 1700000025 THEN 'expired' WHEN p_partkey % 2 = 0 THEN 'ok' ELSE 'invalid' END AS verdict FROM s""")
def q_sign(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_partkey", F.sha2("p_name", 256).alias("id"), F.col("p_brand").alias("name"), (F.lit(1700000000) + F.col("p_size")).alias("exp"))
    sig = I.signature(_KEY, F.col("id"), F.col("name"), F.col("exp"))
    given = F.when(F.col("p_partkey") % 2 == 0, sig).otherwise("0" * 64)
    return t.select("p_partkey", sig.alias("sig"), I.signed_url(_KEY, F.col("id"), F.col("name"), F.col("exp"), "https://h").alias("url"), I.verify(_KEY, F.col("id"), F.col("name"), F.col("exp"), given, F.lit(1700000025)).alias("verdict"))


_ENTITIES = "replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')"
_STRIP = r"regexp_replace(regexp_replace(html, '(?is)<script[\s>].*?</script\s*>|<style[\s>].*?</style\s*>|<noscript[\s>].*?</noscript\s*>', '', 'g'), '(?i)<(?:link|meta)(?:\s[^>]*)?>', '', 'g')"


@query(f"SELECT page_id, {_ENTITIES.format(x="trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")} AS title, CAST(len(string_split(html, '<p>')) - 1 AS BIGINT) AS paragraphs FROM pages")
def q_html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"), M.count_of(F.col("html"), "<p>").alias("paragraphs"))


@query(f"WITH s AS (SELECT page_id, {_STRIP} AS h FROM pages) SELECT page_id, h AS clean, CASE WHEN regexp_matches(h, '(?i)<h1[\\s>]') THEN 'kept' ELSE 'added' END AS heading, NOT contains(lower(h), '<script') AS safe FROM s")
def q_html_sanitize(spark: SparkSession, d: str) -> DataFrame:
    clean = H.drop_dangerous(F.col("html"))
    t = table(spark, d, "pages").select("page_id", clean.alias("clean"), F.lit("T").alias("title"))
    return t.select("page_id", "clean", F.when(H.with_heading(F.col("clean"), F.col("title")) == F.col("clean"), "kept").otherwise("added").alias("heading"), (~F.lower("clean").contains("<script")).alias("safe"))


@query(f"""SELECT page_id, regexp_replace(html, '(?i)(href|src)="/([^/"][^"]*)?"', '\\1="' || regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/\\2"', 'g') AS absolute,
  regexp_replace(html, '(?i)(<head[^>]*>)', '\\1<base href="' || url || '">') AS based FROM pages""")
def q_html_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", H.absolute_links(F.col("html"), F.col("url")).alias("absolute"), H.with_base(F.col("html"), F.col("url")).alias("based"))


@query("""WITH t AS (SELECT page_id, unnest(range(4)) AS k, url FROM pages), i AS (SELECT page_id, k, CASE WHEN k = 3 THEN url || 'x' ELSE 'https://cdn.example.com/' || (page_id % 9) || '/' || (k % 2) || '.png' END AS src FROM t),
f AS (SELECT page_id, src, min(k) AS k FROM i GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS n FROM f)
SELECT page_id, src, 'img_' || lpad(CAST(n AS VARCHAR), 3, '0') || CASE WHEN src LIKE '%.png' THEN '.png' ELSE '.jpg' END AS name FROM r WHERE n <= 2""")
def q_image_downloads(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pages").selectExpr("page_id", "url", "explode(sequence(0, 3)) AS k")
    src = F.expr("CASE WHEN k = 3 THEN url || 'x' ELSE concat('https://cdn.example.com/', cast(page_id % 9 as string), '/', cast(k % 2 as string), '.png') END")
    kind = F.when(F.col("k") == 3, "image/jpeg")
    return P.download_plan(t.select("page_id", "k", src.alias("src"), kind.alias("content_type")), ["page_id"], most=2).select("page_id", "src", "name")


@query()
def q_html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The whole path of a page: decode, extract, sanitise, resolve, serialise."""
    return P.convert(table(spark, d, "pages").select("page_id", "url", "html"))


@query()
def q_extract_content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", H.main_content(F.col("html")).alias("content"))


#: Kinds of input: labelled UTF-8, labelled Latin-1, Latin-1 that only a meta element names, an unknown label, UTF-16, a byte-order mark.
KINDS = 6


@query("""WITH t AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(html, ''), '[^\\x{00}-\\x{FF}]', '?', 'g') AS latin FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 1 THEN latin WHEN 2 THEN '<meta charset="ISO-8859-1">' || latin ELSE html END AS html FROM t""")
def q_decode_html(spark: SparkSession, d: str) -> DataFrame:
    """Pages as bytes of several encodings, told by the header, a meta element, a mark or nothing."""
    kind, html = F.col("page_id") % KINDS, F.coalesce("html", F.lit(""))
    latin = F.regexp_replace(html, r"[^\x{00}-\x{FF}]", "?")
    meta = F.concat(F.lit('<meta charset="ISO-8859-1">'), latin)
    content = F.when(kind == 1, F.encode(latin, "ISO-8859-1")).when(kind == 2, F.encode(meta, "ISO-8859-1")).when(kind == 4, F.encode(html, "UTF-16LE"))
    content = content.when(kind == 5, F.encode(F.concat(F.lit("\ufeff"), html), "UTF-8")).otherwise(html.cast("binary"))
    header = F.when(kind == 0, "text/html; charset=utf-8").when(kind == 1, "text/html; Charset=\"ISO-8859-1\"").when(kind == 3, "text/html; charset=x-none").when(kind == 4, "text/html;charset=utf-16le")
    raw = table(spark, d, "pages").select("page_id", content.alias("content"), header.alias("content_type"))
    return raw.select("page_id", H.decoded(F.col("content"), F.col("content_type")).alias("html"))


@query("""WITH s AS (SELECT event_type AS status, date_trunc('hour', ts) AS h FROM events) SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS hour, status, count(*) AS n FROM s GROUP BY 1, 2""")
def q_queue_progress(spark: SparkSession, d: str) -> DataFrame:
    """The streaming counter of queue states over the stored events, as one batch."""
    from ..streaming.ingest import progress

    counted = progress(table(spark, d, "events").select("ts", F.col("event_type").alias("status")), every="1 hour")
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "status", "n")


SHELL = "CASE page_id % 4 WHEN 0 THEN '<frame src=\"/p' || (page_id + 1) || '\" name=\"x\">' WHEN 1 THEN '<iframe name=\"mainBody\" src=\"http://h/p' || (page_id + 1) || '\"></iframe><iframe src=\"/zzz\"></iframe>' WHEN 2 THEN '<p>' || repeat('w', 250) || '</p><iframe src=\"/p1\"></iframe>' ELSE '<frame src=\"javascript:1\">' END"


@query(f"""WITH p AS (SELECT page_id, 'http://h/p' || page_id AS url, {SHELL} AS html FROM pages),
t AS (SELECT *, CASE WHEN page_id % 4 < 2 THEN 'http://h/p' || (page_id + 1) END AS dst FROM p),
a AS (SELECT t.page_id, coalesce(q.url, t.url) AS url, coalesce(q.html, t.html) AS html, q.dst FROM t LEFT JOIN t q ON q.url = t.dst)
SELECT a.page_id, coalesce(q.url, a.url) AS url, coalesce(q.html, a.html) AS html FROM a LEFT JOIN p q ON q.url = a.dst""")
def q_frames(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pages").selectExpr("page_id", "'http://h/p' || page_id AS url", f"{SHELL} AS html")
    return P.followed(t)


@query("""SELECT p_partkey, '<img src="data:image/png;base64,' || base64(encode(p_name)) || '"><img src="b.png">' AS html FROM part""")
def q_viewer_html(spark: SparkSession, d: str) -> DataFrame:
    images = F.array(F.struct(F.lit("a.png").alias("name"), F.lit("image/png").alias("mime"), F.col("p_name").cast("binary").alias("data")))
    return table(spark, d, "part").select("p_partkey", I.inlined(F.lit('<img src="a.png"><img src="b.png">'), images).alias("html"))
