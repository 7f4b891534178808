"""Queries over requests, results and references."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.routing import asset_url, conflict_path
from ..operators import conversions as V
from ..operators import names as N
from ..operators import store as S
from ..sources.storage import fresh_path
from ..streaming import queue as Q
from .registry import query, table
from .table_queries import CELLS_SQL, flagged

_FAIL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.FAILURES.items())
CODE = f"split_part('{','.join(V.FAILURES)},OTHER', ',', cast(o_orderkey % {len(V.FAILURES) + 1} as int) + 1)"
REASON = f"split_part('{','.join(V.FETCH_STATUS)},odd', ',', cast(o_orderkey % {len(V.FETCH_STATUS) + 1} as int) + 1)"


@query(f"""WITH t AS (SELECT o_orderkey, {CODE} AS code, {REASON} AS reason, CAST(o_custkey AS VARCHAR) AS e FROM orders)
SELECT o_orderkey, CASE WHEN code = 'OTHER' THEN '문서 변환에 실패했습니다: ' || e ELSE (CASE code {_FAIL} END) || ' (' || e || ')' END AS message,
  CASE WHEN reason IN ('scheme-blocked', 'host-blocked') THEN 400 WHEN reason = 'too-large' THEN 413 WHEN reason = 'odd' THEN NULL ELSE 502 END AS status FROM t""")
def q_failure_messages(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").selectExpr("o_orderkey", f"{CODE} AS code", f"{REASON} AS reason", "cast(o_custkey as string) AS e")
    return t.select("o_orderkey", V.failure_message(F.col("code"), F.col("e")).alias("message"), V.fetch_status(F.col("reason")).alias("status"))


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '/f/' || o_custkey END AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'http://h/' || o_custkey END AS url, CASE o_orderkey % 5 WHEN 1 THEN base64(encode('abc')) WHEN 2 THEN '!' WHEN 3 THEN '' END AS b FROM orders),
f AS (SELECT '/f/' || c_custkey AS at, repeat('x', CAST(c_custkey % 30 AS INT)) AS c FROM customer WHERE c_custkey % 4 > 0 UNION ALL SELECT 'http://h/' || c_custkey, 'yy' FROM customer),
j AS (SELECT t.*, CASE WHEN path IS NOT NULL THEN 'path' WHEN url IS NOT NULL THEN 'url' WHEN coalesce(b, '') <> '' THEN 'base64' END AS source, f.c FROM t LEFT JOIN f ON f.at = coalesce(path, url)),
k AS (SELECT *, CASE WHEN source = 'base64' THEN CASE WHEN b = '!' THEN NULL ELSE 'abc' END ELSE c END AS content FROM j)
SELECT o_orderkey, source, CASE WHEN source IS NULL THEN 'no-input' WHEN content IS NULL THEN CASE WHEN source = 'base64' THEN 'bad-base64' ELSE 'not-found' END WHEN content = '' THEN 'empty' WHEN length(content) > 20 THEN 'too-large' END AS error,
  CASE WHEN content IS NOT NULL AND length(content) BETWEEN 1 AND 20 THEN CAST(length(content) AS INT) END AS bytes FROM k""")
def q_input_resolver(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN '/f/' || o_custkey END AS path", "CASE WHEN o_orderkey % 2 = 0 THEN 'http://h/' || o_custkey END AS url", "CASE o_orderkey % 5 WHEN 1 THEN 'YWJj' WHEN 2 THEN '!' WHEN 3 THEN '' END AS base64")
    c = table(spark, d, "customer")
    files = c.where("c_custkey % 4 > 0").selectExpr("'/f/' || c_custkey AS location", "cast(repeat('x', cast(c_custkey % 30 as int)) as binary) AS content").unionByName(c.selectExpr("'http://h/' || c_custkey AS location", "cast('yy' as binary) AS content"))
    return V.resolved_input(t, files, limit=20).select("o_orderkey", "source", "error", F.octet_length("content").alias("bytes"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'no-text' WHEN p_size % 2 = 0 AND p_size % 5 > 0 THEN '일부 페이지(' || p_size % 5 || '쪽)가 이미지로만 구성되어 해당 텍스트가 누락될 수 있습니다.' END AS warning FROM part""")
def q_pdf_policy(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 4 = 0 THEN ' <!-- x --> ' ELSE p_name END AS md", "CASE WHEN p_size % 2 = 0 THEN 'Mixed' ELSE 'TextBased' END AS kind", "p_size % 5 AS pages")
    return t.select("p_partkey", V.pdf_warnings(F.col("md"), F.col("kind"), F.col("pages")).alias("warning"))


@query("""SELECT p_partkey, '{"markdown":"' || p_name || '","format":"pdf","elapsed":' || p_size || ',"imageCount":2,"outputPath":"out/' || p_partkey || '.md"' || CASE WHEN p_size % 2 = 0 THEN ',"warnings":["w"]' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ',"hiddenExcluded":{"sheets":1,"rows":' || p_size || ',"cols":0}' ELSE '' END || '}' AS line FROM part""")
def q_result_json(spark: SparkSession, d: str) -> DataFrame:
    hidden = F.when(F.col("p_size") % 3 == 0, F.struct(F.lit(1).alias("sheets"), F.col("p_size").alias("rows"), F.lit(0).alias("cols")))
    warnings = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>"))
    line = V.result_json(F.col("p_name"), F.lit("pdf"), F.col("p_size"), F.lit(2), F.concat(F.lit("out/"), F.col("p_partkey").cast("string"), F.lit(".md")), warnings, hidden)
    return table(spark, d, "part").select("p_partkey", line.alias("line"))


PLACE = "split_part('/a/b.pdf;/c.pdf;d.pdf;https://h/x.html;rel/e.pdf', ';', cast(p_partkey % 5 as int) + 1)"
SRC = "split_part('./img/a b.png;#top;http://h/x.png;img/%20c.png;/abs.png;', ';', cast(p_partkey % 6 as int) + 1)"


@query(f"""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'out' ELSE CASE p_partkey % 5 WHEN 0 THEN '/a' WHEN 1 THEN '/' WHEN 4 THEN 'rel' END END AS reveal,
  CASE p_partkey % 6 WHEN 0 THEN 'base/img/a b.png' WHEN 1 THEN '#top' WHEN 2 THEN 'http://h/x.png' WHEN 3 THEN 'base/img/ c.png' WHEN 4 THEN '/abs.png' ELSE '' END AS asset,
  CASE WHEN p_size % 3 = 0 OR p_size % 2 = 0 THEN {PLACE} WHEN p_partkey % 2 = 0 THEN regexp_replace({PLACE}, '\\.([a-z]+)$', ' (1).\\1') END AS target FROM part""")
def q_output_paths(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr("p_partkey", "p_size", f"{PLACE} AS place", f"{SRC} AS src")
    policy = F.when(F.col("p_size") % 2 == 0, "overwrite").when(F.col("p_partkey") % 2 == 0, "rename").otherwise("skip")
    return t.select("p_partkey", V.reveal_folder(F.when(F.col("p_size") % 4 == 0, "out"), F.col("place")).alias("reveal"), asset_url(F.col("src"), F.lit("base/")).alias("asset"), conflict_path(F.col("place"), F.col("p_size") % 3 > 0, policy).alias("target"))


TREE = "concat('/root/', CASE WHEN o_custkey % 7 = 0 THEN '.hidden/' ELSE '' END, repeat('d/', cast(o_custkey % 11 as int)), lpad(cast(o_orderkey as string), 7, '0'), CASE WHEN o_orderkey % 3 = 0 THEN '.pdf' WHEN o_orderkey % 3 = 1 THEN '.md' ELSE '.exe' END)"


@query(f"""WITH t AS (SELECT {TREE} AS path FROM orders), r AS (SELECT path, substr(path, 7) AS rel FROM t WHERE NOT contains(path, '/.') AND NOT path LIKE '%.exe')
SELECT path, 'root' || CASE WHEN contains(rel, '/') THEN '/' || regexp_extract(rel, '^(.*)/[^/]*$', 1) ELSE '' END AS group_dir FROM r WHERE len(string_split(rel, '/')) - 1 <= 8 ORDER BY string_split(rel, '/') LIMIT 500""")
def q_folder_scan(spark: SparkSession, d: str) -> DataFrame:
    return V.folder_scan(table(spark, d, "orders").selectExpr(f"{TREE} AS path"), "/root")


@query(f"""WITH {CELLS_SQL}, c AS (SELECT sheet, row, col, '<' || t || CASE WHEN col % 4 = 2 THEN ' class="xlsx-hidden-col"' ELSE '' END || '>' || CASE WHEN h THEN '<a href="u?a&amp;b">' || CASE WHEN text = '' THEN 'u?a&amp;b' ELSE text END || '</a>' ELSE text END || '</' || t || '>' AS html
  FROM (SELECT *, CASE WHEN row = 0 THEN 'th' ELSE 'td' END AS t, (row + col) % 10 = 3 AS h FROM dense)),
r AS (SELECT sheet, row, '<tr>' || string_agg(html, '' ORDER BY col) || '</tr>' AS html FROM c GROUP BY 1, 2)
SELECT sheet, '<table>' || string_agg(html, '' ORDER BY row) || '</table>' AS html FROM r GROUP BY sheet""")
def q_sheet_html(spark: SparkSession, d: str) -> DataFrame:
    t = flagged(spark, d).withColumns({"row_span": F.lit(1), "col_span": F.lit(1), "covered": F.lit(False), "href": F.when((F.col("row") + F.col("col")) % 10 == 3, "u?a&b")})
    return V.sheet_html(t, ["sheet"])


@query(f"WITH {CELLS_SQL} SELECT sheet, CAST(0 AS BIGINT) AS \"table\", row, col, replace(text, '|', '\\|') AS text FROM dense UNION ALL SELECT sheet, 1, 0, 0, 'tail' FROM size")
def q_parse_tables(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.grid import pipe_tables

    md = pipe_tables(flagged(spark, d), ["sheet"]).withColumn("markdown", F.concat("markdown", F.lit("\n\ntext\n\n| tail |")))
    return V.parse_pipe_tables(md, ["sheet"]).withColumn("table", F.col("table").cast("long"))


@query("""WITH i AS (SELECT p_brand, p_partkey, 'img' || p_partkey || '.png' AS name FROM part WHERE p_partkey % 3 > 0), r AS (SELECT p_brand, p_partkey AS seq, 'img' || (p_partkey - p_partkey % 2) || CASE WHEN p_partkey % 5 = 0 THEN '.png' ELSE '' END AS ref FROM part),
j AS (SELECT r.p_brand, seq, ref, name FROM r JOIN i ON i.p_brand = r.p_brand AND (ref = name OR ref || '.png' = name))
SELECT *, row_number() OVER (PARTITION BY p_brand, name ORDER BY seq) = 1 AS first_use FROM j""")
def q_used_images(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part")
    images = t.where("p_partkey % 3 > 0").selectExpr("p_brand", "'img' || p_partkey || '.png' AS name")
    refs = t.selectExpr("p_brand", "p_partkey AS seq", "'img' || (p_partkey - p_partkey % 2) || CASE WHEN p_partkey % 5 = 0 THEN '.png' ELSE '' END AS ref")
    return V.used_images(refs, images, ["p_brand"])


@query("""SELECT o_orderkey, 'b0' AS locator, 'o' || o_orderkey AS text FROM orders UNION ALL SELECT l_orderkey, 'b0/c' || (k - 1) || '.0/p0', l_returnflag || k FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) JOIN orders ON o_orderkey = l_orderkey""")
def q_text_segments(spark: SparkSession, d: str) -> DataFrame:
    """An order as a document: a paragraph with a table, one cell a line item."""
    items = table(spark, d, "lineitem").selectExpr("l_orderkey AS o_orderkey", "l_returnflag", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k")
    cell = F.struct((F.col("k") - 1).alias("row"), F.lit(0).alias("col"), F.array(F.struct(F.concat("l_returnflag", F.col("k").cast("string")).alias("text"))).alias("paragraphs"))
    cells = items.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    docs = table(spark, d, "orders").select("o_orderkey").join(cells, "o_orderkey", "left")
    docs = docs.select("o_orderkey", F.array(F.struct(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("text"), "cells")).alias("paragraphs"))
    return V.segments(docs, ["o_orderkey"])


@query("""
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS conversion_id, lang FROM documents),
gone AS (SELECT DISTINCT conversion_id FROM t WHERE doc_id % 5 = 0),
back AS (SELECT DISTINCT conversion_id FROM t WHERE lang = 'fr')
SELECT conversion_id, CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT conversion_id FROM t) WHERE conversion_id NOT IN (FROM gone) OR conversion_id IN (FROM back)""")
def q_store_writers(spark: SparkSession, d: str) -> DataFrame:
    """What a store lists after two writers at once, a deletion, a third batch and a compaction: each identifier once."""
    content = F.coalesce("text", F.lit(""))
    docs = table(spark, d, "documents").select("doc_id", "lang", S.conversion_id(content, F.lit(False)).alias("conversion_id"), content.alias("markdown"))
    schema, path = "conversion_id string, doc_id long, markdown string", fresh_path(spark, "store")
    with ThreadPoolExecutor(2) as pool:
        for done in [pool.submit(S.ConversionStore(spark, path, schema).put, docs.where(f"doc_id % 3 <> {k}")) for k in (0, 1)]:
            done.result()
    store = S.ConversionStore(spark, path, schema)
    store.delete(docs.where("doc_id % 5 = 0"))
    store.put(docs.where("lang = 'fr'"))
    store.compact()
    return store.list().groupBy("conversion_id").agg(F.count("*").alias("n"))


#: Events of a queue of users: most are a start or an end, and a new request of whom has none waiting.
QUEUE_EVENT = "split_part('enqueue,start,done,start,fail,fail,skip,cancel,start,enqueue', ',', cast((event_id * 7 + user_id) % 10 + 1 as int))"


@query(f"""
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS item, epoch_ms(ts) AS ms, {QUEUE_EVENT} AS event, event_type AS error, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (
  SELECT item, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS status, 0 AS attempts, CAST(NULL AS BIGINT) AS started, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT item FROM e)
  UNION ALL
  SELECT item, k,
    CASE WHEN event = 'enqueue' AND coalesce(status, 'done') IN ('done', 'error', 'cancelled') THEN 'pending' WHEN event = 'start' AND status = 'pending' THEN 'converting' WHEN event = 'done' AND status = 'converting' THEN 'done'
      WHEN event = 'fail' AND status = 'converting' THEN CASE WHEN attempts <= 2 THEN 'pending' ELSE 'error' END WHEN event = 'skip' AND status = 'converting' THEN 'pending' WHEN event = 'cancel' AND status = 'pending' THEN 'cancelled' ELSE status END,
    CASE WHEN event = 'enqueue' AND coalesce(status, 'done') IN ('done', 'error', 'cancelled') THEN 0 WHEN event = 'start' AND status = 'pending' THEN attempts + 1 WHEN event = 'skip' AND status = 'converting' THEN attempts - 1 ELSE attempts END,
    CASE WHEN event = 'start' AND status = 'pending' THEN ms WHEN event IN ('done', 'fail', 'skip') AND status = 'converting' THEN NULL ELSE started END,
    CASE WHEN event = 'fail' AND status = 'converting' THEN why WHEN event = 'enqueue' AND coalesce(status, 'done') IN ('done', 'error', 'cancelled') OR event = 'start' AND status = 'pending' OR event IN ('done', 'skip') AND status = 'converting' OR event = 'cancel' AND status = 'pending' THEN NULL ELSE error END
  FROM (SELECT s.item, e.k, e.ms, e.event, e.error AS why,
          CASE WHEN late THEN CASE WHEN attempts <= 2 THEN 'pending' ELSE 'error' END ELSE status END AS status, attempts, CASE WHEN late THEN NULL ELSE started END AS started, CASE WHEN late THEN 'timeout' ELSE s.error END AS error
        FROM (SELECT s.*, e.k AS next, s.status = 'converting' AND s.started + 86400000 <= e.ms AS late FROM s JOIN e ON e.item = s.item AND e.k = s.k + 1) s JOIN e ON e.item = s.item AND e.k = s.next)
),
last AS (SELECT item, status, attempts, started, error FROM s WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item ORDER BY k DESC) = 1),
final AS (SELECT *, status = 'converting' AND started + 86400000 <= (SELECT max(ms) FROM e) AS late FROM last)
SELECT item, CASE WHEN late THEN CASE WHEN attempts <= 2 THEN 'pending' ELSE 'error' END ELSE status END AS status, attempts, CASE WHEN late THEN 'timeout' ELSE error END AS error FROM final""")
def q_queue_states(spark: SparkSession, d: str) -> DataFrame:
    """Last states of a queue's items, with retries and a timeout of a day."""
    events = table(spark, d, "events").selectExpr("cast(user_id as string) AS item", "ts", "event_id AS seq", f"{QUEUE_EVENT} AS event", "event_type AS error")
    return Q.states(events, Q.Rules(timeout=86_400_000)).select("item", "status", "attempts", "error")


@query("""
WITH r AS (SELECT o_orderkey, 'out/' || o_orderpriority || CASE WHEN o_custkey % 5 = 0 THEN ' (2)' ELSE '' END || '.md' AS path, CASE WHEN o_orderkey % 11 = 0 THEN 'skip' ELSE 'rename' END AS policy FROM orders),
taken AS (SELECT DISTINCT path FROM (SELECT 'out/' || o_orderpriority || ' (' || o_orderkey % 40 * 3 || ').md' AS path FROM orders UNION ALL SELECT 'out/1-URGENT.md')),
firsts AS (SELECT path, min(o_orderkey) AS k FROM r WHERE path NOT IN (FROM taken) GROUP BY 1),
used AS (SELECT path FROM taken UNION SELECT path FROM firsts),
rest AS (SELECT r.path, count(*) AS n FROM r LEFT JOIN firsts f ON f.path = r.path AND f.k = r.o_orderkey WHERE f.k IS NULL AND policy = 'rename' GROUP BY 1),
free AS (SELECT path, n, k, row_number() OVER (PARTITION BY path ORDER BY k) AS place FROM (SELECT path, n, unnest(range(1, n + 200)) AS k FROM rest) WHERE regexp_replace(path, '[.]md$', ' (' || k || ').md') NOT IN (FROM used))
SELECT regexp_replace(path, '[.]md$', ' (' || k || ').md') AS target FROM free WHERE place <= n UNION ALL SELECT path FROM firsts""")
def q_free_names(spark: SparkSession, d: str) -> DataFrame:
    """Targets of a batch in which few names are asked for by all rows, some of whose numbers are taken."""
    orders = table(spark, d, "orders")
    asked = orders.selectExpr("o_orderkey AS order", "'out/' || o_orderpriority || CASE WHEN o_custkey % 5 = 0 THEN ' (2)' ELSE '' END || '.md' AS path", "CASE WHEN o_orderkey % 11 = 0 THEN 'skip' ELSE 'rename' END AS policy")
    taken = orders.selectExpr("'out/' || o_orderpriority || ' (' || cast(o_orderkey % 40 * 3 as string) || ').md' AS path").unionByName(spark.createDataFrame([("out/1-URGENT.md",)], "path string"))
    return N.allotted(asked, taken).where("target IS NOT NULL").select("target")
