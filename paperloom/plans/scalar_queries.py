"""Queries over column functions. Inputs that the tables lack are composed by expressions that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cellformat as C
from ..functions import routing as R
from ..functions import safety as S
from ..functions import text as T
from .registry import query, table

EXTENSIONS = "HWP,hwpx,doc,docx,pdf,xls,xlsx,html,htm,md,exe"
PATH = f"concat('in/doc_', cast(o_orderkey as string), '.', split_part('{EXTENSIONS}', ',', cast(o_orderkey % 11 as int) + 1))"
FORMAT_CASE = "CASE {e} WHEN 'htm' THEN 'html' ELSE CASE WHEN {e} IN ('hwp','hwpx','doc','docx','pdf','xls','xlsx','html') THEN {e} END END"
EXT = r"regexp_extract(lower({p}), '\.([^./\\]+)$', 1)"
HOST = r"lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
URL_PATH = r"(CASE WHEN regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1) END)"
SLUG = f"substr(regexp_replace(regexp_replace({HOST} || {URL_PATH}, '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80)"


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


@query(f"""
WITH t AS (SELECT o_orderkey, {PATH} AS path FROM orders), x AS (SELECT *, {EXT.format(p="path")} AS e FROM t)
SELECT o_orderkey, path, {FORMAT_CASE.format(e="e")} AS format, e IN ('hwp','hwpx','doc','docx','pdf','xls','xlsx','html','htm') AS in_core,
       e IN ('hwp','hwpx','doc','docx','pdf','xls','xlsx') AS in_service, e <> 'exe' AS in_app
FROM x""")
def q_format_detect(spark: SparkSession, d: str) -> DataFrame:
    t = orders(spark, d).selectExpr("o_orderkey", f"{PATH} AS path")
    return t.select("o_orderkey", "path", R.detect_format(F.col("path")).alias("format"), *[R.accepted(F.col("path"), k).alias(f"in_{k}") for k in ("core", "service", "app")])


@query(f"""
WITH t AS (SELECT url AS input FROM pages UNION ALL SELECT {PATH} FROM orders),
x AS (SELECT input, input AS url, regexp_matches(input, '(?i)^https?://') AS web, regexp_extract(input, '([^/\\\\]*)$', 1) AS base, {EXT.format(p="input")} AS e FROM t),
y AS (SELECT *, CASE WHEN web THEN {SLUG} ELSE regexp_replace(base, '\\.[^.]*$', '') END AS name FROM x)
SELECT input, CASE WHEN web THEN 'html' ELSE {FORMAT_CASE.format(e="e")} END AS format, name || '_images' AS images_folder,
       (CASE WHEN web THEN '' ELSE regexp_extract(input, '^(.*[/\\\\])', 1) END) || name || '.md' AS beside, 'out/' || name || '.md' AS in_folder
FROM y""")
def q_resolve_input(spark: SparkSession, d: str) -> DataFrame:
    paths = orders(spark, d).selectExpr(f"{PATH} AS input")
    t = table(spark, d, "pages").selectExpr("url AS input").unionByName(paths)
    x = F.col("input")
    return t.select("input", R.resolve_format(x).alias("format"), R.images_folder(x).alias("images_folder"), R.markdown_path(x).alias("beside"), R.markdown_path(x, F.lit("out/")).alias("in_folder"))


@query(f"""
SELECT page_id, url, {SLUG} AS slug, {HOST} || regexp_replace({URL_PATH}, '/$', '') AS display,
       regexp_matches(url, '(?i)^https?://[^/?#\\s]+') AS is_http, nullif(regexp_extract({URL_PATH}, '([^/]*)$', 1), '') AS base
FROM pages""")
def q_url_slug(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", "url", R.url_slug(u).alias("slug"), R.url_display(u).alias("display"), R.is_http_url(u).alias("is_http"), R.url_basename(u).alias("base"))


IP = "concat(cast(l_partkey % 256 as string), '.', cast(l_suppkey * 37 % 300 as string), '.', cast(l_orderkey % 256 as string), '.', cast(l_linenumber as string))"
URI = "concat(split_part('JavaScript: ,data:text/html;,data:image/png;,https://x/,vb script:,/local/,java\tscript:,#top', ',', cast(l_partkey % 8 as int) + 1), cast(l_linenumber as string))"


@query(f"""
WITH t AS (SELECT l_orderkey, l_linenumber, {IP} AS ip, {URI} AS uri FROM lineitem),
p AS (SELECT *, CAST(split_part(ip, '.', 1) AS BIGINT) AS a, CAST(split_part(ip, '.', 2) AS BIGINT) AS b, regexp_replace(lower(uri), '[\\x00-\\x20]', '', 'g') AS u FROM t)
SELECT l_orderkey, l_linenumber, ip, uri,
  b > 255 OR a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19)) OR a >= 224 AS blocked,
  starts_with(u, 'javascript:') OR starts_with(u, 'vbscript:') OR (starts_with(u, 'data:') AND NOT starts_with(u, 'data:image/')) AS dangerous,
  regexp_extract(u, '^([a-z][a-z0-9+.-]*):', 1) IN ('', 'http', 'https', 'data', 'blob') AS viewable
FROM p""")
def q_url_guard(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{IP} AS ip", f"{URI} AS uri")
    return t.withColumns({"blocked": S.is_blocked_ip(F.col("ip")), "dangerous": S.is_dangerous_uri(F.col("uri")), "viewable": S.is_viewer_uri(F.col("uri"))})


FETCH = "concat(split_part('http,https,ftp,file', ',', cast(o_orderkey % 4 as int) + 1), '://', split_part('example.com,10.0.0.7,8.8.8.8', ',', cast(o_custkey % 3 as int) + 1), '/a')"


@query(f"""
WITH t AS (SELECT o_orderkey, {FETCH} AS url, o_custkey % 5 AS k, o_orderkey % 7 AS hops, o_custkey * 400000 AS size FROM orders)
SELECT o_orderkey, url,
  CASE WHEN NOT regexp_matches(url, '^https?:') THEN 'unsupported-scheme' WHEN contains(url, '10.0.0.7') THEN 'blocked-address'
       WHEN contains(url, '8.8.8.8') THEN 'ok' WHEN k = 0 THEN 'dns-failure' WHEN k = 1 THEN 'blocked-address' ELSE 'ok' END AS verdict,
  CASE WHEN hops > 3 THEN 'too-many-redirects' WHEN size > 20971520 THEN 'too-large' WHEN k = 2 THEN 'unsupported-content-type' ELSE 'ok' END AS response
FROM t""")
def q_fetch_guard(spark: SparkSession, d: str) -> DataFrame:
    t = orders(spark, d).selectExpr("o_orderkey", f"{FETCH} AS url", "o_custkey % 5 AS k", "o_orderkey % 7 AS hops", "o_custkey * 400000 AS size")
    ips = F.when(F.col("k") == 0, F.array().cast("array<string>")).when(F.col("k") == 1, F.array(F.lit("93.184.216.34"), F.lit("192.168.1.4"))).otherwise(F.array(F.lit("93.184.216.34")))
    kind = F.when(F.col("k") == 2, "application/pdf").when(F.col("k") == 3, "Text/HTML; charset=utf-8")
    return t.select("o_orderkey", "url", S.fetch_verdict(F.col("url"), ips).alias("verdict"), S.response_verdict(kind, F.col("size"), F.col("hops")).alias("response"))


HINT = "CASE WHEN o_orderkey % 3 = 0 THEN concat('hint', cast(o_custkey as string), split_part('.pdf,.zip,.docx', ',', cast(o_custkey % 3 as int) + 1)) END"
HEADER = "CASE WHEN o_orderkey % 4 > 0 THEN concat('attachment; filename=', split_part('\"a b.pdf\",plain.xlsx,\"no/slash.zip\"', ',', cast(o_orderkey % 3 as int) + 1), CASE WHEN o_orderkey % 5 = 0 THEN concat('; filename*=UTF-8''''r%20', cast(o_custkey as string), '.hwp') ELSE '' END) END"
HEADER_SPARK = HEADER.replace("''''", "\\'\\'")


@query(f"""
WITH t AS (SELECT o_orderkey, {HINT} AS hint, {HEADER} AS header, concat('https://h.example.com/f/', cast(o_orderkey as string), split_part('.doc,.bin,', ',', cast(o_orderkey % 3 as int) + 1)) AS url FROM orders),
n AS (SELECT *, nullif(replace(regexp_replace(CASE WHEN contains(header, 'filename*') THEN replace(regexp_extract(header, 'filename\\*=UTF-8''''([^;]+)', 1), '%20', ' ')
        WHEN contains(header, 'filename="') THEN regexp_extract(header, 'filename="([^"]*)"', 1) ELSE regexp_extract(header, 'filename=([^;"\\s]+)', 1) END, '[\\x00-\\x1f]', ''), '/', '_'), '') AS header_name,
        regexp_extract(url, '([^/]*)$', 1) AS url_name FROM t),
c AS (SELECT *, regexp_matches(coalesce(hint, ''), '\\.(pdf|docx)$') AS ok1, regexp_matches(coalesce(header_name, ''), '\\.(pdf|xlsx|hwp)$') AS ok2, regexp_matches(url_name, '\\.doc$') AS ok3 FROM n)
SELECT o_orderkey, header_name, CASE WHEN ok1 THEN hint WHEN ok2 THEN header_name WHEN ok3 THEN url_name ELSE coalesce(hint, header_name, url_name) END AS name FROM c""")
def q_name_choice(spark: SparkSession, d: str) -> DataFrame:
    t = orders(spark, d).selectExpr("o_orderkey", f"{HINT} AS hint", f"{HEADER_SPARK} AS header", "concat('https://h.example.com/f/', cast(o_orderkey as string), split_part('.doc,.bin,', ',', cast(o_orderkey % 3 as int) + 1)) AS url")
    named = t.withColumn("header_name", R.disposition_name(F.col("header")))
    return named.select("o_orderkey", "header_name", R.chosen_name(F.col("hint"), F.col("header_name"), R.url_basename(F.col("url"))).alias("name"))


RAW_BYTES = "CASE o_orderkey % 4 WHEN 0 THEN 'D0CF11E0A1B11AE1' WHEN 1 THEN '504B0304' WHEN 2 THEN '48575020446F63756D656E742046696C65' ELSE '25504446' END"


@query(f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'hwp' WHEN 1 THEN 'hwpx' WHEN 2 THEN 'hwp' END AS container, length({RAW_BYTES}) / 2 + 1 <= 9 AS within_limit FROM orders""")
def q_container_sniff(spark: SparkSession, d: str) -> DataFrame:
    content = F.concat(F.unhex(F.expr(RAW_BYTES)), F.unhex(F.lit("00")))
    return orders(spark, d).select("o_orderkey", R.sniff(content).alias("container"), (F.octet_length(content) <= 9).alias("within_limit"))


CODES = [*T.PUA_SYMBOLS, *T.PLANE_15, 0xF0FF, *(ord(c) for c in T.CANONICAL_GLYPHS)]
_FROM = "".join(f"chr({k})||" for k in [*T.PUA_SYMBOLS, *T.PLANE_15])[:-2]
_TO = "".join([*T.PUA_SYMBOLS.values(), *map(chr, T.PLANE_15.values())])
_ZERO = "".join(f"chr({ord(c)})||" for c in T.ZERO_WIDTH)[:-2]


@query(f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_shipmode_text || chr(CAST(list_element([{", ".join(map(str, CODES))}], CAST(k AS BIGINT) + 1) AS INTEGER)) || chr(8203) || 'x' AS raw
  FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_shipmode_text, (l_orderkey * 7 + l_partkey) % {len(CODES)} AS k FROM lineitem)),
n AS (SELECT *, translate(raw, {_FROM}, '{_TO}') AS symbols FROM t)
SELECT l_orderkey, l_linenumber, symbols, translate(symbols, '{"".join(T.CANONICAL_GLYPHS)}', '{"".join(T.CANONICAL_GLYPHS.values())}') AS canonical,
       translate(raw, {_ZERO}, '') AS visible FROM n""")
def q_glyphs(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array(*[F.lit(chr(k)) for k in CODES])
    t = table(spark, d, "lineitem").withColumn("k", F.expr(f"cast((l_orderkey * 7 + l_partkey) % {len(CODES)} as int)"))
    raw = F.concat("l_returnflag", F.get(codes, F.col("k")), F.lit("\u200bx"))
    symbols = T.normalize_symbols(raw)
    return t.select("l_orderkey", "l_linenumber", symbols.alias("symbols"), T.canonical_glyphs(symbols).alias("canonical"), T.strip_zero_width(raw).alias("visible"))


@query("""
WITH t AS (SELECT p_partkey, p_name, p_name || CASE p_partkey % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.tif' ELSE '' END AS file, split_part('image/png,image/jpeg,image/svg+xml,text/plain', ',', CAST(p_partkey % 4 AS INT) + 1) AS mime FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/tiff' ELSE 'application/octet-stream' END AS type,
  CASE mime WHEN 'image/png' THEN '.png' WHEN 'image/jpeg' THEN '.jpg' WHEN 'image/svg+xml' THEN '.svg' ELSE '.bin' END AS extension,
  'img_' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END || '.jpg' AS numbered,
  regexp_replace(file, '[^\\w.-]', '_', 'g') || CASE WHEN p_partkey % 3 < 2 THEN '' ELSE CASE mime WHEN 'image/png' THEN '.png' WHEN 'image/jpeg' THEN '.jpg' WHEN 'image/svg+xml' THEN '.svg' ELSE '.bin' END END AS stored
FROM t""")
def q_image_names(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr("p_partkey", "p_name || CASE p_partkey % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.tif' ELSE '' END AS file", "split_part('image/png,image/jpeg,image/svg+xml,text/plain', ',', cast(p_partkey % 4 as int) + 1) AS mime")
    return t.select("p_partkey", T.mime_of(F.col("file")).alias("type"), T.extension_of(F.col("mime")).alias("extension"), T.image_name(F.col("p_partkey"), F.lit("jpg")).alias("numbered"), T.safe_image_name(F.col("file"), F.col("mime")).alias("stored"))


MARKED = "concat('**', p_brand, '** `', p_type, '` _', cast(p_size as string), '_ [', p_name, '](http://x/', cast(p_partkey as string), ') ~~old~~ __u__ & <', p_brand, '>')"


@query(f"""
WITH t AS (SELECT p_partkey, {MARKED} AS md FROM part),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '`([^`]+)`', '\\1', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\*([^*]+)\\*', '\\1', 'g'), '__([^_]+)__', '\\1', 'g'), '_([^_]+)_', '\\1', 'g'), '~~([^~]+)~~', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g') AS plain FROM t)
SELECT p_partkey, plain, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(plain, '\\s+', '-', 'g'), '[!"#$%&''()*+,./:;<=>?@\\[\\\\\\]^`{{|}}~]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
  replace(replace(replace(md, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, regexp_replace(md, '[^A-Za-z0-9_.\\-가-힣]', '_', 'g') AS temp_name
FROM s""")
def q_markdown_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr("p_partkey", f"{MARKED} AS md").withColumn("plain", T.strip_inline(F.col("md")))
    return t.select("p_partkey", "plain", T.slugify(F.col("plain"), ascii_only=True).alias("slug"), T.html_escape(F.col("md")).alias("escaped"), T.safe_temp_name(F.col("md")).alias("temp_name"))


LEADER = "concat(' ', p_name, ' ', repeat('.', cast(p_size % 7 as int)), ' ', cast(p_size as string), repeat(' ', cast(p_size % 3 as int)))"


@query(f"""
WITH t AS (SELECT p_partkey, {LEADER} AS line, CASE WHEN p_size % 5 = 0 THEN p_size END AS page FROM part)
SELECT p_partkey, regexp_replace(line, '\\s*[·.]{{4,}}\\s*', ' — ', 'g') AS cleaned, rtrim(substr(line, 2)) AS trimmed,
  regexp_replace('<!-- ' || line || ' -->' || CASE WHEN page IS NULL THEN ' ' ELSE 'x' END, '<!--.*?-->', '', 'g') NOT IN (' ', '') AS has_text,
  CASE WHEN page IS NULL THEN 'bad' ELSE CAST(page AS VARCHAR) || '쪽: bad' END AS warning
FROM t""")
def q_line_cleanup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr("p_partkey", f"{LEADER} AS line", "CASE WHEN p_size % 5 = 0 THEN p_size END AS page")
    commented = F.concat(F.lit("<!-- "), "line", F.lit(" -->"), F.when(F.col("page").isNull(), " ").otherwise("x"))
    return t.select("p_partkey", T.leaders_and_bullets(F.col("line")).alias("cleaned"), T.trim_edges(F.col("line")).alias("trimmed"), T.has_text(commented).alias("has_text"), T.warning_text(F.col("page"), F.lit("bad")).alias("warning"))


STYLE = "split_part('1. 제목,1.1 부제목,부제목2,1.1.1 소제목,나열 1,바탕글', ',', cast(p_partkey % 6 as int) + 1)"
SHAPE = "split_part('SOLID,NONE,3D,DASH_DOT,THICK_SLIM_LINE', ',', cast(p_partkey % 5 as int) + 1)"


@query(f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS level, p_partkey % 6 = 4 AS is_list, p_partkey % 5 IN (0, 3, 4) AND p_partkey % 4 > 0 AS struck, p_partkey % 4 > 0 AS bare FROM part""")
def q_paragraph_styles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr("p_partkey", f"{STYLE} AS style", f"{SHAPE} AS shape", "p_partkey % 4 > 0 AS present")
    return t.select("p_partkey", T.style_level(F.col("style")).alias("level"), T.is_list_style(F.col("style")).alias("is_list"), T.is_struck(F.col("present"), F.col("shape")).alias("struck"), T.is_struck(F.col("present"), F.lit(None).cast("string")).alias("bare"))


@query("SELECT doc_id, nfc_normalize(coalesce(text, '') || chr(101) || chr(769)) AS text FROM documents")
def q_nfc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.nfc(F.concat(F.coalesce("text", F.lit("")), F.lit("é"))).alias("text"))


_BUILT_IN = " ".join(f"WHEN {k} THEN '{v}'" for k, v in C.BUILTIN.items())
CUSTOM = "CASE WHEN l_orderkey % 13 = 0 THEN '\"date\"#,##0.0\"kg\"' WHEN l_orderkey % 17 = 0 THEN '[Red]$#,##0.00;0' WHEN l_orderkey % 19 = 0 THEN 'yyyy\\\\-mm\\\\-dd' END"
CUSTOM_DUCK = CUSTOM.replace("\\\\", "\\")
FORMAT_ID = "cast((l_orderkey + l_linenumber * 5) % 52 as int)"
_STRIP = r"regexp_replace(regexp_replace(regexp_replace({c}, '\"[^\"]*\"', '', 'g'), '\[[^\]]*\]', '', 'g'), '\\.', '', 'g')"
CODES_SQL = f"""
t AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, {FORMAT_ID} AS format_id, {CUSTOM_DUCK} AS custom FROM lineitem),
c AS (SELECT *, coalesce(custom, CASE format_id {_BUILT_IN} END) AS code FROM t),
k AS (SELECT *, lower({_STRIP.format(c="code")}) AS bare, regexp_extract(code, '^([^;]*)', 1) AS section FROM c),
f AS (SELECT *, CASE WHEN code IS NULL THEN 'general' WHEN regexp_matches(bare, '[ymdhs]') THEN CASE WHEN regexp_matches(bare, '[hs]') THEN 'datetime' ELSE 'date' END WHEN contains(bare, '%') THEN 'percent' WHEN regexp_matches(bare, '[#0]') THEN 'number' ELSE 'general' END AS kind,
  length(regexp_replace(regexp_extract({_STRIP.format(c="section")}, '\\.(.*)$', 1), '[^0#]', '', 'g')) AS decimals, coalesce(regexp_matches({_STRIP.format(c="section")}, '[#0],[#0]'), false) AS thousands,
  CASE WHEN starts_with(custom, '[Red]') THEN '$' WHEN starts_with(custom, '\"date') THEN 'date' ELSE '' END AS prefix, CASE WHEN starts_with(custom, '\"date') THEN 'kg' ELSE '' END AS suffix FROM k)
"""


def coded(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", f"{FORMAT_ID} AS format_id", f"{CUSTOM} AS custom")
    return t.withColumn("code", C.format_code(F.col("format_id"), F.col("custom")))


@query(f"WITH {CODES_SQL} SELECT l_orderkey, l_linenumber, code, kind, coalesce(decimals, 0) AS decimals, thousands, CASE WHEN kind = 'number' THEN prefix END AS prefix, CASE WHEN kind = 'number' THEN suffix END AS suffix FROM f")
def q_format_classify(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("code")
    prefix, suffix = C.affixes(code)
    t = coded(spark, d).withColumn("kind", C.classify(code))
    number = F.col("kind") == "number"
    return t.select("l_orderkey", "l_linenumber", "code", "kind", F.coalesce(C.decimal_places(code), F.lit(0)).cast("long").alias("decimals"), F.coalesce(C.has_thousands(code), F.lit(False)).alias("thousands"), F.when(number & prefix.isNotNull(), prefix).alias("prefix"), F.when(number & suffix.isNotNull(), suffix).alias("suffix"))


#: A double below 2**27 as a whole number of 2**-60ths, exactly, and from it the rounded digits: whole numbers all the way.
ROUNDED_SQL = "(CAST({x} * pow(2, 60) AS HUGEINT) * CAST(pow(10, {places}) AS HUGEINT) * 2 + CAST(pow(2, 60) AS HUGEINT)) // CAST(pow(2, 61) AS HUGEINT)"
#: Amounts with many digits; odd numbers over a power of two, ties among them; decimals that end with a five, which no double is.
AMOUNTS = "CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice * l_discount * (1 + l_tax) WHEN 1 THEN (2 * l_partkey + 1) / pow(2, 1 + l_orderkey % 6) ELSE (l_partkey * 10 + 5) / CAST(1000 AS DOUBLE) END"
PLACES = "CAST(CASE l_linenumber % 3 WHEN 2 THEN 2 ELSE l_orderkey % 5 END AS INT)"


@query(f"""WITH {CODES_SQL},
v AS (SELECT *, l_extendedprice * (1 - l_discount) AS x, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '' END AS sign FROM f WHERE kind = 'number'),
n AS (SELECT *, {ROUNDED_SQL.format(x="x", places="decimals")} AS n, CAST(pow(10, decimals) AS HUGEINT) AS unit FROM v),
b AS (SELECT *, CASE WHEN thousands THEN ltrim(format('{{:,}}', CAST(n // unit AS BIGINT))) ELSE CAST(n // unit AS VARCHAR) END || CASE WHEN decimals > 0 THEN '.' || lpad(CAST(n % unit AS VARCHAR), CAST(decimals AS INT), '0') ELSE '' END AS body FROM n)
SELECT l_orderkey, l_linenumber, code, CASE WHEN x > 0 THEN sign ELSE '' END || prefix || body || suffix AS shown FROM b""")
def q_format_number(spark: SparkSession, d: str) -> DataFrame:
    """Amounts of all rows whose code is a number's, with as many places as it says: nearly all need rounding."""
    t = coded(spark, d).where(C.classify(F.col("code")) == "number")
    value = F.col("l_extendedprice") * (1 - F.col("l_discount")) * F.expr("CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END")
    return t.select("l_orderkey", "l_linenumber", "code", C.format_number(value, F.col("code")).alias("shown"))


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, {AMOUNTS} AS x, {PLACES} AS places FROM lineitem),
n AS (SELECT *, {ROUNDED_SQL.format(x="x", places="places")} AS n, CAST(pow(10, places) AS HUGEINT) AS unit FROM v)
SELECT l_orderkey, l_linenumber, places, CASE WHEN l_orderkey % 2 = 0 AND x > 0 THEN '-' ELSE '' END || CAST(n // unit AS VARCHAR) || CASE WHEN places > 0 THEN '.' || lpad(CAST(n % unit AS VARCHAR), places, '0') ELSE '' END AS shown FROM n""")
def q_exact_rounding(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"CASE WHEN l_orderkey % 2 = 0 THEN -1 ELSE 1 END * ({AMOUNTS}) AS x", f"{PLACES} AS places")
    return t.select("l_orderkey", "l_linenumber", "places", C.fixed(F.col("x"), F.col("places")).alias("shown"))


#: Sign, exponent and mantissa of packed doubles, and their flag for hundredths; every third row holds an integer.
PACKED = "l_orderkey % 2 AS s, 1003 + l_partkey % 41 AS e, (l_orderkey * 7919 + l_linenumber * 104729) % 262144 AS m, l_linenumber % 2 AS hundredths, (l_orderkey + l_linenumber) % 3 = 0 AS whole, (l_partkey * 37 + l_orderkey) % 536870912 * CASE WHEN l_orderkey % 2 = 1 THEN -1 ELSE 1 END AS i"


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, {PACKED} FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN whole THEN CAST(i AS DOUBLE) ELSE CASE WHEN s = 1 THEN -1 ELSE 1 END * (1 + m / CAST(262144 AS DOUBLE)) * pow(2, e - 1023) END / CASE WHEN hundredths = 1 THEN CAST(100 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS value FROM v""")
def q_packed_numbers(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", *PACKED.split(", "))
    bits = F.expr("CASE WHEN whole THEN i * 4 + 2 + hundredths ELSE s * -2147483648 + e * 1048576 + m * 4 + hundredths END")
    return t.select("l_orderkey", "l_linenumber", C.rk_number(bits.cast("int")).alias("value"))


@query("""
WITH t AS (SELECT o_orderkey, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) + (o_orderkey % 24) / 24.0 AS serial, o_orderkey % 7 = 0 AS old FROM orders
  UNION ALL SELECT -p_partkey, CAST(p_partkey % 100 AS DOUBLE), false FROM part)
SELECT o_orderkey, strftime(make_timestamp(CAST(floor((CASE WHEN old THEN serial + 1462 WHEN serial < 60 THEN serial + 1 ELSE serial END - 25569) * 86400000 + 0.5) AS BIGINT) * 1000), '%Y-%m-%d %H:%M:%S') AS at,
  strftime(make_timestamp(CAST(floor((CASE WHEN old THEN serial + 1462 WHEN serial < 60 THEN serial + 1 ELSE serial END - 25569) * 86400000 + 0.5) AS BIGINT) * 1000), '%Y-%m-%d') AS day
FROM t""")
def q_serial_dates(spark: SparkSession, d: str) -> DataFrame:
    t = orders(spark, d).selectExpr("o_orderkey", "datediff(cast(o_orderdate as date), DATE'1899-12-30') + (o_orderkey % 24) / 24.0D AS serial", "o_orderkey % 7 = 0 AS old")
    t = t.unionByName(table(spark, d, "part").selectExpr("-p_partkey AS o_orderkey", "cast(p_partkey % 100 as double) AS serial", "false AS old"))
    return t.select("o_orderkey", *[C.serial_to_text(F.col("serial"), F.col("old"), F.lit(k)).alias(n) for k, n in ((True, "at"), (False, "day"))])


@query(f"""WITH {CODES_SQL},
v AS (SELECT *, coalesce(decimals, 0) AS places, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(20000 + l_orderkey % 30000 AS INT) AS serial, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '' END AS sign FROM f)
SELECT l_orderkey, l_linenumber, kind, CASE kind
  WHEN 'percent' THEN CASE WHEN places = 2 THEN format('{{:.2f}}', round(l_discount * 100)) ELSE CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) END || '%'
  WHEN 'number' THEN sign || prefix || CASE WHEN thousands THEN ltrim(format('{{:,}}', cents // 100)) ELSE CAST(cents // 100 AS VARCHAR) END || CASE places WHEN 0 THEN '' WHEN 2 THEN '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') ELSE '.' || repeat('0', places) END || suffix
  WHEN 'date' THEN strftime(DATE '1899-12-30' + serial, '%Y-%m-%d') WHEN 'datetime' THEN strftime(DATE '1899-12-30' + serial, '%Y-%m-%d') || ' 12:00:00'
  ELSE 'n/a' END AS shown FROM v""")
def q_format_cell(spark: SparkSession, d: str) -> DataFrame:
    """The dispatcher over all kinds: raw text of a percentage, a number (cents where two places show), a serial or none of them."""
    t = coded(spark, d).withColumn("kind", C.classify(F.col("code"))).withColumn("places", F.coalesce(C.decimal_places(F.col("code")), F.lit(0)))
    t = t.withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long")).withColumn("serial", (20000 + F.col("l_orderkey") % 30000).cast("string"))
    number = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise(""), F.expr("cast(cents div 100 as string)"), F.when(F.col("places") == 2, F.concat(F.lit("."), F.lpad(F.expr("cast(cents % 100 as string)"), 2, "0"))).otherwise(""))
    raw = F.when(F.col("kind") == "percent", F.col("l_discount").cast("string")).when(F.col("kind") == "number", number)
    raw = raw.when(F.col("kind") == "date", F.col("serial")).when(F.col("kind") == "datetime", F.concat("serial", F.lit(".5"))).otherwise("n/a")
    return t.select("l_orderkey", "l_linenumber", "kind", C.format_cell(raw, F.col("code"), F.lit(False)).alias("shown"))


@query("""
SELECT p_partkey, CASE WHEN p_size <= 26 THEN chr(64 + p_size) ELSE chr(64 + (p_size - 1) // 26) || chr(65 + (p_size - 1) % 26) END || CAST(p_partkey AS VARCHAR) AS reference,
  p_size - 1 AS col, p_partkey - 1 AS row, CASE p_size % 8 WHEN 0 THEN '#NULL!' WHEN 7 THEN '#DIV/0!' ELSE '#ERR!' END AS error,
  CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS DOUBLE) ELSE p_partkey / 100.0 END AS packed
FROM part""")
def q_cell_references(spark: SparkSession, d: str) -> DataFrame:
    reference = F.expr("concat(CASE WHEN p_size <= 26 THEN char(64 + p_size) ELSE concat(char(64 + (p_size - 1) div 26), char(65 + (p_size - 1) % 26)) END, cast(p_partkey as string))")
    t = table(spark, d, "part").withColumn("reference", reference)
    rk = (F.col("p_partkey").cast("int") * 4) + 2 + F.col("p_size") % 2
    return t.select("p_partkey", "reference", C.column_number(F.col("reference")).alias("col"), C.row_number_of(F.col("reference")).cast("long").alias("row"), C.error_text(F.col("p_size") % 8).alias("error"), C.rk_number(rk.cast("int")).alias("packed"))
