"""Queries over documents as lines: outline, sections, repairs, search, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import has_text
from ..operators import fidelity as FI
from ..operators import inverted_index as II
from ..operators import lines as L
from ..operators import metrics as M
from ..operators import outline as O
from ..operators import runs as U
from ..operators import search as X
from ..sources.storage import fresh_path
from .registry import query, table

#: A conversation as Markdown: a heading for each turn, then its text on one line.
HEAD = "repeat('#', cast(1 + turn % 3 as int)) || ' ' || role || ' **' || cast(turn % 4 as string) || '**'"
TURN = f"{HEAD} || chr(10) || regexp_replace(text, '[\\n\\r#`~]+', ' '{{g}}) || chr(10)"
SPARK_TURN, DUCK_TURN = TURN.format(g="").replace("\\n\\r", "\\\\n\\\\r"), TURN.format(g=", 'g'")
DOCS_SQL = f"docs AS (SELECT conv_id, string_agg({DUCK_TURN}, chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id)"
LINES_SQL = """
raws AS (SELECT conv_id, unnest(string_split(markdown, chr(10))) AS raw, unnest(range(len(string_split(markdown, chr(10))))) AS line, len(string_split(markdown, chr(10))) AS n FROM docs),
heads AS (SELECT conv_id, line, n, length(regexp_extract(raw, '^(#{1,6})\\s+(.+?)\\s*#*\\s*$', 1)) AS level, replace(trim(regexp_extract(raw, '^(#{1,6})\\s+(.+?)\\s*#*\\s*$', 2)), '**', '') AS text FROM raws),
nodes AS (SELECT *, lower(regexp_replace(text, '\\s+', '-', 'g')) AS base FROM heads WHERE level > 0),
anchored AS (SELECT *, base || CASE WHEN row_number() OVER (PARTITION BY conv_id, base ORDER BY line) = 1 THEN '' ELSE '-' || (row_number() OVER (PARTITION BY conv_id, base ORDER BY line) - 1) END AS anchor FROM nodes)
"""
SECTIONS_SQL = """
sections AS (SELECT a.conv_id, a.line, a.level, a.text, a.anchor, coalesce((SELECT min(b.line) FROM anchored b WHERE b.conv_id = a.conv_id AND b.line > a.line AND b.level <= a.level), a.n) AS "end",
  lag(a.anchor) OVER (PARTITION BY a.conv_id ORDER BY a.line) AS prev, lead(a.anchor) OVER (PARTITION BY a.conv_id ORDER BY a.line) AS next FROM anchored a),
paths AS (SELECT s.conv_id, s.line, string_agg(a.text, ' / ' ORDER BY a.line) AS path FROM sections s JOIN anchored a ON a.conv_id = s.conv_id AND (a.line = s.line OR (a.line < s.line AND a.level < s.level
  AND NOT EXISTS (SELECT 1 FROM anchored m WHERE m.conv_id = a.conv_id AND m.line > a.line AND m.line <= s.line AND m.level <= a.level))) GROUP BY 1, 2)
"""


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, markdown: turns in order."""
    turns = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{SPARK_TURN.replace('chr(', 'char(')} AS t")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "t")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("markdown"))


@query(f"WITH {DOCS_SQL}, {LINES_SQL} SELECT conv_id, line, level, text, anchor FROM anchored")
def q_outline(spark: SparkSession, d: str) -> DataFrame:
    return O.outline(conversations(spark, d), ["conv_id"], ascii_only=True).withColumns({"level": F.col("level").cast("long"), "line": F.col("line").cast("long")})


@query(f'WITH {DOCS_SQL}, {LINES_SQL}, {SECTIONS_SQL} SELECT s.conv_id, s.line AS start, s."end", s.level, s.text, s.anchor, s.prev, s.next, p.path, (SELECT string_agg(r.raw, chr(10) ORDER BY r.line) FROM raws r WHERE r.conv_id = s.conv_id AND r.line >= s.line AND r.line < s."end") AS markdown FROM sections s JOIN paths p USING (conv_id, line)')
def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = O.chunks(conversations(spark, d), ["conv_id"], ascii_only=True)
    return c.select("conv_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("level").cast("long").alias("level"), "text", "anchor", "prev", "next", F.array_join("path", " / ").alias("path"), "markdown")


@query(f"WITH {DOCS_SQL}, {LINES_SQL}, {SECTIONS_SQL} SELECT s.conv_id, s.line AS start, s.\"end\", (SELECT string_agg(r.raw, chr(10) ORDER BY r.line) FROM raws r WHERE r.conv_id = s.conv_id AND r.line >= s.line AND r.line < s.\"end\") AS markdown FROM sections s WHERE s.anchor = 'user-1'")
def q_chunk_by_anchor(spark: SparkSession, d: str) -> DataFrame:
    return O.chunk(conversations(spark, d), ["conv_id"], anchor="user-1").select("conv_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "markdown")


@query(f"WITH {DOCS_SQL}, {LINES_SQL} SELECT conv_id, min(line) AS start, max(line) + 1 AS \"end\", string_agg(raw, chr(10) ORDER BY line) AS markdown FROM raws WHERE line BETWEEN 2 AND 6 GROUP BY conv_id")
def q_chunk_by_range(spark: SparkSession, d: str) -> DataFrame:
    return O.chunk(conversations(spark, d), ["conv_id"], lines=(2, 7)).select("conv_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "markdown")


FENCED = "CASE turn % 3 WHEN 1 THEN '```' ELSE repeat('#', cast(1 + turn % 2 as int)) || ' ' || role END"


@query(f"""
WITH t AS (SELECT conv_id, {FENCED} AS raw, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line FROM conversations),
m AS (SELECT *, starts_with(raw, '```') AS mark, coalesce(sum(CASE WHEN starts_with(raw, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT conv_id, line, raw, mark OR before % 2 = 1 AS fenced FROM m""")
def q_fences(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{FENCED} AS raw")
    docs = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "raw"))), lambda x: x["raw"]), "\n").alias("markdown"))
    return L.fenced_exactly(docs, "markdown").withColumn("line", F.col("line").cast("long"))


TOC_LINE = "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE repeat('#', cast(2 + p_partkey % 3 * 2 as int)) || ' ' END || p_name || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ' ..... ' || cast(p_size as string) END"


@query(f"""
WITH t AS (SELECT p_brand, p_partkey AS line, {TOC_LINE} AS raw FROM part),
e AS (SELECT *, regexp_matches(raw, '[.]{{4,}}\\s*\\d+$') AS entry, length(regexp_extract(raw, '^(#{{1,6}})', 1)) AS level, regexp_extract(raw, '^(?:#{{1,6}}\\s+)?(.+?)\\s*[.]{{4,}}\\s*(\\d+)$', 1) AS title, regexp_extract(raw, '(\\d+)$', 1) AS page FROM t),
l AS (SELECT *, CASE WHEN entry AND level > 0 THEN level END AS lv FROM e),
r AS (SELECT *, CASE WHEN lv IS NULL THEN 0 ELSE dense_rank() OVER (PARTITION BY p_brand ORDER BY lv ASC NULLS LAST) - 1 END AS depth FROM l)
SELECT p_brand, line, CASE WHEN entry THEN repeat('  ', CAST(depth AS INT)) || '- ' || title || ' — ' || page ELSE raw END AS rendered FROM r""")
def q_toc(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr("p_brand", "p_partkey AS line", f"{TOC_LINE} AS raw")
    return L.toc_entries(t, ["p_brand"]).select("p_brand", "line", "rendered")


FALSE_LINE = "CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'plain' ELSE repeat('#', cast(1 + l_suppkey % 2 as int)) || ' Title ' || cast(l_partkey as string) || CASE WHEN l_partkey % 4 = 0 THEN '.' ELSE '' END END"
LINE_ORDER = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)"


@query(f"""
WITH t AS (SELECT l_orderkey, {LINE_ORDER} AS line, {FALSE_LINE} AS raw FROM lineitem),
v AS (SELECT *, length(regexp_extract(raw, '^(#{{1,6}})\\s', 1)) AS level, raw = '' AS blank FROM t),
c AS (SELECT *, coalesce(lag(level) OVER w <> level, true) OR level = 0 AS change FROM v WINDOW w AS (PARTITION BY l_orderkey, blank ORDER BY line)),
i AS (SELECT *, sum(CASE WHEN change THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, blank ORDER BY line) AS island FROM c),
n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, blank, island) AS run FROM i)
SELECT l_orderkey, line, CASE WHEN level > 0 AND (run >= 3 OR raw LIKE '%.') THEN regexp_replace(raw, '^#+ ', '') ELSE raw END AS demoted FROM n""")
def q_false_headings(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", f"{LINE_ORDER} AS line", f"{FALSE_LINE} AS raw").withColumn("line", F.col("line").cast("long"))
    return L.demote_false_headings(t, ["l_orderkey"]).select("l_orderkey", "line", "demoted")


ROW_LINE = "CASE l_suppkey % 6 WHEN 0 THEN '```' WHEN 1 THEN '| ** | <br/> |' WHEN 2 THEN '| --- | --- |' WHEN 3 THEN '|  | &nbsp; |' ELSE '| ' || l_returnflag || ' | x |' END"


@query(f"""
WITH t AS (SELECT l_orderkey, {LINE_ORDER} AS line, {ROW_LINE} AS raw FROM lineitem),
m AS (SELECT *, raw = '```' AS fence, lead(raw) OVER w AS nx, coalesce(sum(CASE WHEN raw = '```' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS open FROM t WINDOW w AS (PARTITION BY l_orderkey ORDER BY line))
SELECT l_orderkey, line, raw FROM m WHERE open OR fence OR raw NOT IN ('| ** | <br/> |', '|  | &nbsp; |') OR coalesce(nx = '| --- | --- |', false)""")
def q_empty_rows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", f"{LINE_ORDER} AS line", f"{ROW_LINE} AS raw").withColumn("line", F.col("line").cast("long"))
    return L.drop_empty_rows(t, ["l_orderkey"]).select("l_orderkey", "line", "raw")


@query()
def q_repair(spark: SparkSession, d: str) -> DataFrame:
    """The whole clean-up in order; its steps are compared one by one in q_toc and q_false_headings."""
    t = table(spark, d, "part").selectExpr("p_brand", "p_partkey AS line", f"{TOC_LINE} AS raw")
    return L.repair(L.joined_lines(t, ["p_brand"]), ["p_brand"])


@query("""
SELECT doc_id, CAST(len(string_split(lower(coalesce(text, '')), 'the')) - 1 AS BIGINT) AS n, length(coalesce(text, '')) > 0 AS has_text FROM documents""")
def q_search_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return t.select("doc_id", X.match_count(F.col("text"), "the").alias("n"), has_text(F.col("text")).alias("has_text"))


@query("""
WITH s AS (SELECT doc_id, string_split(lower(text), 'idiot') AS parts FROM documents WHERE contains(lower(text), 'idiot')),
e AS (SELECT doc_id, unnest(parts) AS gap, unnest(range(len(parts))) AS k, len(parts) AS n FROM s),
o AS (SELECT doc_id, k, n, sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY k) + k * 5 AS pos FROM e)
SELECT doc_id, k, CAST(pos AS BIGINT) AS "offset" FROM o WHERE k < n - 1 AND k < 2000""")
def q_search_matches(spark: SparkSession, d: str) -> DataFrame:
    return X.matches(table(spark, d, "documents"), ["doc_id"], "idiot").withColumn("k", F.col("k").cast("long"))


@query("""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'idiot')) AS a, len(list_filter(w, lambda x: x = 'license')) AS b FROM w),
g AS (SELECT (SELECT count(*) FROM documents) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM n)
SELECT doc_id, round(ln((docs - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln((docs - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score
FROM n, g WHERE a > 0 OR b > 0""")
def q_bm25(spark: SparkSession, d: str) -> DataFrame:
    return X.bm25(table(spark, d, "documents"), "doc_id", ["idiot", "license"]).withColumn("score", F.round("score", 6))


@query("""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
sizes AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w),
q AS (SELECT item_id, word, min(k) AS k FROM (SELECT item_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')[1:6] AS words FROM benchmark)) GROUP BY 1, 2),
tf AS (SELECT doc_id, n, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM w) WHERE word IN (SELECT word FROM q) GROUP BY 1, 2, 3),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
x AS (SELECT item_id, doc_id, list(ln((docs - df + 0.5) / (df + 0.5) + 1) * (CAST(tf AS DOUBLE) * 2.2 / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * n / mean))) ORDER BY k) AS parts FROM q JOIN tf USING (word) JOIN df USING (word), sizes GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, round(list_sum(parts), 6) AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s)
SELECT item_id, CAST(place AS INT) AS place, score FROM r WHERE place <= 20""")
def q_search_top(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best documents for the first six words of every benchmark item, by a stored index that is searched by blocks.

    Scores are compared by place: documents whose scores differ beyond the sixth digit only may stand in either order.
    """
    index = II.build(table(spark, d, "documents"), "doc_id", fresh_path(spark, "search-index"))
    words = II.words_of(F.col("text"))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.slice(words, 1, 6).alias("words"))
    return index.top(queries, 20).select(F.col("query").alias("item_id"), "place", F.round("score", 6).alias("score"))


@query("""
WITH t AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', '', 'g') AS a, regexp_replace(lower(regexp_replace(coalesce(text, ''), 'tion|\\n[^\\n]{0,40}', '', 'g')), '[^\\p{L}\\p{N}]+', '', 'g') AS b FROM documents),
ga AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, substr(a, i, 5) AS g FROM (SELECT doc_id, a, unnest(range(1, greatest(length(a) - 4, 1) + 1)) AS i FROM t WHERE a <> '')) GROUP BY 1, 2),
gb AS (SELECT doc_id, g, count(*) AS m FROM (SELECT doc_id, substr(b, i, 5) AS g FROM (SELECT doc_id, b, unnest(range(1, greatest(length(b) - 4, 1) + 1)) AS i FROM t WHERE b <> '')) GROUP BY 1, 2),
s AS (SELECT doc_id, sum(n) AS grams, sum(least(n, coalesce(m, 0))) AS found FROM ga LEFT JOIN gb USING (doc_id, g) GROUP BY 1)
SELECT doc_id, CAST(coalesce(grams, 0) AS BIGINT) AS grams, CAST(coalesce(found, 0) AS BIGINT) AS found, round(found / grams, 6) AS recall FROM t LEFT JOIN s USING (doc_id)""")
def q_text_recall(spark: SparkSession, d: str) -> DataFrame:
    """Five-gram recall of texts that lost a syllable and short lines."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    lossy = docs.withColumn("text", F.regexp_replace("text", "tion|\\n[^\\n]{0,40}", ""))
    return FI.recall(docs, lossy, ["doc_id"]).withColumn("recall", F.round("recall", 6))


@query("""SELECT 'c' || (o_custkey % 9) || '/o' || o_orderkey || '.pdf' AS path FROM orders WHERE o_custkey % 9 = 3""")
def q_files_under(spark: SparkSession, d: str) -> DataFrame:
    """Files below a folder, without those of folders whose names only begin alike."""
    files = table(spark, d, "orders").selectExpr("concat('c', cast(o_custkey % 9 as string), '/o', cast(o_orderkey as string), '.pdf') AS path")
    more = files.select(F.regexp_replace("path", "^c3/", "c33/").alias("path")).where("path LIKE 'c33/%'")
    return M.files_under(files.unionByName(more), "c3/")


TABLE_MD = "'# ' || p_name || chr(10) || '| a | b |' || chr(10) || '| --- | :---: |' || chr(10) || repeat('| 1 | 2 |' || chr(10), cast(p_size % 4 as int)) || repeat('<table><tr colspan=2></tr></table>', cast(p_size % 3 as int))"


@query(f"""
WITH t AS (SELECT p_partkey, p_name, p_size FROM part)
SELECT p_partkey, CAST(1 AS BIGINT) AS pipe_tables, CAST(2 + p_size % 4 + 0 AS BIGINT) AS pipe_rows, CAST(p_size % 3 AS BIGINT) AS html_tables, CAST(p_size % 3 AS BIGINT) AS html_rows, CAST(p_size % 3 AS BIGINT) AS col_spans, CAST(0 AS BIGINT) AS row_spans, CAST(1 AS BIGINT) AS headings,
  length({TABLE_MD.replace("cast(", "CAST(")}) AS chars FROM t""")
def q_table_stats(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr("p_partkey", f"{TABLE_MD.replace('chr(', 'char(')} AS md")
    return t.select("p_partkey", *[c.alias(n) for n, c in M.table_statistics(F.col("md")).items()], M.heading_count(F.col("md")).alias("headings"), F.length("md").cast("long").alias("chars"))


@query("SELECT g AS glyph, CAST(sum(length(t) - length(replace(t, g, ''))) AS BIGINT) AS n FROM (SELECT repeat('●□', CAST(p_size AS INT)) || repeat('✓', CAST(p_partkey % 3 AS INT)) AS t FROM part), (SELECT unnest(string_split('●,○,■,□,▪,•,➢,✗,✓,☒,☑,◆', ',')) AS g) GROUP BY g")
def q_glyph_census(spark: SparkSession, d: str) -> DataFrame:
    return M.glyph_counts(table(spark, d, "part").selectExpr("repeat('●□', cast(p_size as int)) || repeat('✓', cast(p_partkey % 3 as int)) AS t"), "t")


PAIRED = "(SELECT d.doc_id, coalesce(d.text, '') AS a, b.text AS b FROM documents d JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark) b ON d.doc_id % n = k)"


def paired(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id"), F.col("text").alias("b"))
    ranked = items.withColumn("k", F.row_number().over(Window.orderBy("item_id")) - 1)
    return docs.withColumn("k", F.pmod("doc_id", F.lit(items.count()))).join(ranked, "k").select("doc_id", F.coalesce("text", F.lit("")).alias("a"), "b")


@query(f"SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_extract_all(b, '[a-z]{{4,}}')) AS token, regexp_replace(a, '\\s+', '', 'g') AS plain FROM {PAIRED}) WHERE NOT contains(plain, token)")
def q_residual_tokens(spark: SparkSession, d: str) -> DataFrame:
    p = paired(spark, d)
    return M.residual_tokens(p.select("doc_id", F.col("b").alias("text")), p.select("doc_id", F.col("a").alias("text")), ["doc_id"], "[a-z]{4,}")


@query("SELECT o_orderkey, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest([replace(CAST(o_orderkey AS VARCHAR), '.', ''), CAST(o_custkey AS VARCHAR) || '50']) AS x EXCEPT SELECT unnest([CAST(o_custkey AS VARCHAR) || '50']))) AS missing FROM orders")
def q_number_diff(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").selectExpr("o_orderkey", "concat('n ', cast(o_orderkey as string), ' and ', cast(o_custkey as string), '.50') AS a", "concat('x', cast(o_custkey as string), ',50') AS b")
    missing = F.array_join(F.array_sort(M.number_difference(F.col("a"), F.col("b"))), ",")
    return t.select("o_orderkey", F.when(missing != "", missing).alias("missing"))


@query("""
WITH t AS (SELECT p_partkey, p_name || ' ' || p_type AS a, p_name || ' | x' AS b FROM part)
SELECT p_partkey, CAST(length(a) AS BIGINT) AS chars_a, CAST(length(b) AS BIGINT) AS chars_b, CAST(len(string_split_regex(a, '\\s+')) AS BIGINT) AS words_a, CAST(len(string_split_regex(b, '\\s+')) AS BIGINT) AS words_b, round((length(b) - length(a)) * 100.0 / length(a), 1) AS delta_percent FROM t""")
def q_compare_converters(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part")
    both = M.compare(t.selectExpr("p_partkey", "p_name || ' ' || p_type AS markdown"), t.selectExpr("p_partkey", "p_name || ' | x' AS markdown"), ["p_partkey"])
    return both.select("p_partkey", "chars_a", "chars_b", "words_a", "words_b", F.col("delta_percent").cast("double").alias("delta_percent"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type IN ('click', 'view') AS is_list, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
s AS (SELECT *, NOT is_list OR NOT coalesce(lag(is_list) OVER (PARTITION BY user_id ORDER BY seq), false) AS st FROM e),
g AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS grp FROM s)
SELECT user_id, CAST(grp AS BIGINT) AS "group", count(*) AS items, CASE WHEN is_list THEN '<ul><li>' || string_agg(event_type, '</li><li>' ORDER BY seq) || '</li></ul>' ELSE '<p>' || string_agg(event_type, '' ORDER BY seq) || '</p>' END AS html FROM g GROUP BY user_id, grp, is_list""")
def q_list_groups(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").selectExpr("user_id", "event_type IN ('click', 'view') AS is_list", "event_type AS text", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq")
    return U.list_groups(t, ["user_id"])


@query(f"""
WITH t AS (SELECT l_orderkey, {LINE_ORDER} AS seq, l_returnflag = 'R' AS bold, l_linestatus = 'O' AS italic, l_quantity > 25 AS struck, l_returnflag || CAST(l_linenumber AS VARCHAR) AS text FROM lineitem),
c AS (SELECT *, coalesce((lag(bold) OVER w, lag(italic) OVER w, lag(struck) OVER w) <> (bold, italic, struck), true) OR row_number() OVER w = 1 AS new FROM t WINDOW w AS (PARTITION BY l_orderkey ORDER BY seq)),
i AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY seq) AS island FROM c),
s AS (SELECT l_orderkey, island, bold, italic, struck, string_agg(text, '' ORDER BY seq) AS t FROM i GROUP BY ALL),
h AS (SELECT l_orderkey, island, CASE WHEN bold THEN '<strong>' ELSE '' END || CASE WHEN italic THEN '<em>' ELSE '' END || CASE WHEN struck THEN '<del>' ELSE '' END || t || CASE WHEN struck THEN '</del>' ELSE '' END || CASE WHEN italic THEN '</em>' ELSE '' END || CASE WHEN bold THEN '</strong>' ELSE '' END AS h FROM s)
SELECT l_orderkey, string_agg(h, '' ORDER BY island) AS html FROM h GROUP BY l_orderkey""")
def q_run_tags(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", f"{LINE_ORDER} AS seq", "l_returnflag = 'R' AS bold", "l_linestatus = 'O' AS italic", "l_quantity > 25 AS struck", "l_returnflag || cast(l_linenumber as string) AS text")
    return U.style_tags(t, ["l_orderkey"])


SCALE = "CASE WHEN l_returnflag = 'R' THEN 2.0 ELSE 1.0 END"


@query(f"""
WITH t AS (SELECT l_orderkey AS page, {LINE_ORDER} AS seq, l_suppkey % 3 AS place, {SCALE} * (l_suppkey % 3 * 4.25 + l_partkey % 2 * 2.0) AS x, {SCALE} * (l_linenumber % 2) * 2.0 AS y, l_returnflag AS text, l_linestatus AS font FROM lineitem)
SELECT page, font, text, CAST(arg_min(x, seq) AS DOUBLE) AS x, CAST(arg_min(y, seq) AS DOUBLE) AS y, CAST(min(seq) AS INT) AS seq FROM t GROUP BY page, font, text, place""")
def q_run_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a place differ by as much as counts as one place (2, or a quarter of the height); places by a little more."""
    t = table(spark, d, "lineitem").selectExpr("l_orderkey AS page", f"cast({LINE_ORDER} as int) AS seq", f"cast({SCALE} * (l_suppkey % 3 * 4.25 + l_partkey % 2 * 2.0) as double) AS x", f"cast({SCALE} * (l_linenumber % 2) * 2.0 as double) AS y", "5.0D AS width", f"cast({SCALE} * 8 as double) AS height", "l_returnflag AS text", "l_linestatus AS font")
    return U.drop_overdraws(t, ["page"]).select("page", "font", "text", "x", "y", "seq")


PAD = "CASE cast(l_quantity as int) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.25 ELSE 0.0 END"


@query(f"""
WITH t AS (SELECT l_orderkey AS page, {LINE_ORDER} AS seq, l_returnflag || CAST(l_linenumber AS VARCHAR) AS text, {PAD} > 1 AS gap, l_quantity > 40 AS tall FROM lineitem),
n AS (SELECT *, gap OR tall <> coalesce(lag(tall) OVER (PARTITION BY page ORDER BY seq), tall) AS new FROM t),
i AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY seq) AS island FROM n)
SELECT page, CAST(min(seq) AS INT) AS seq, string_agg(text, '' ORDER BY seq) AS text FROM i GROUP BY page, island""")
def q_run_merge(spark: SparkSession, d: str) -> DataFrame:
    """Gaps at and above what may lie between joined runs, lines that differ by as much as they may, two heights."""
    t = table(spark, d, "lineitem").selectExpr("l_orderkey AS page", f"cast({LINE_ORDER} as int) AS seq", f"cast({PAD} as double) AS pad", "l_quantity > 40 AS tall", "l_linenumber", "l_returnflag || cast(l_linenumber as string) AS text")
    x = F.sum(F.col("pad") + 5.0).over(Window.partitionBy("page").orderBy("seq")) - 5.0
    runs = t.select("page", "seq", x.alias("x"), (10.0 + F.col("l_linenumber") % 2 * 0.5).alias("y"), F.lit(5.0).alias("width"), F.when(F.col("tall"), 9.0).otherwise(8.0).alias("height"), "text", F.lit("f").alias("font"))
    return U.merge_adjacent(runs, ["page"]).select("page", "seq", "text")


@query(f"WITH {DOCS_SQL}, {LINES_SQL}, {SECTIONS_SQL} SELECT s.conv_id, min(s.line) AS start FROM sections s JOIN paths p USING (conv_id, line) WHERE p.path = 'user 0 / assistant 1' GROUP BY s.conv_id")
def q_chunk_by_path(spark: SparkSession, d: str) -> DataFrame:
    return O.chunk(conversations(spark, d), ["conv_id"], path=["user 0", "assistant 1"]).select("conv_id", F.col("start").cast("long").alias("start"))
