"""Requests and results of conversions: inputs, policies, messages, records, nested text and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.routing import accepted, is_http_url
from ..functions.text import from_map, has_text, html_escape
from .lines import explode_lines

# Messages by failure code, shown to readers of the converted documents.
FAILURES = {
    "EMPTY_INPUT": "입력 파일이 비어 있습니다.", "UNSUPPORTED_FORMAT": "지원하지 않는 문서 형식입니다.",
    "ENCRYPTED": "암호로 보호된 문서입니다. 한글/오피스에서 암호를 해제한 뒤 다시 시도해주세요.",
    "DRM_PROTECTED": "DRM(배포용 문서 보안)으로 보호된 문서입니다. 원본 작성 기관에 일반 문서를 요청해주세요.",
    "CORRUPTED": "문서 파일이 손상되어 읽을 수 없습니다.", "DECOMPRESSION_BOMB": "비정상적으로 큰 압축 데이터가 감지되어 변환을 중단했습니다.",
    "ZIP_BOMB": "비정상적으로 큰 압축 데이터가 감지되어 변환을 중단했습니다.",
    "IMAGE_BASED_PDF": "텍스트 없이 이미지로만 구성된 PDF입니다. 텍스트를 추출할 수 없습니다.", "NO_SECTIONS": "문서에서 본문 섹션을 찾을 수 없습니다.",
    "PARSE_ERROR": "문서 구조를 해석하지 못했습니다.", "MISSING_DEPENDENCY": "변환에 필요한 구성 요소가 설치되어 있지 않습니다.",
    "OUTPUT_TOO_LARGE": "변환 결과가 너무 커서 출력할 수 없습니다.",
}
# HTTP status by reason of a failed fetch.
FETCH_STATUS = {"scheme-blocked": "400", "host-blocked": "400", "too-large": "413", "timeout": "502", "redirect-loop": "502", "http-error": "502", "network-error": "502"}
MAX_UPLOAD = 50 * 1024 * 1024
MAX_DEPTH, MAX_FILES = 8, 500


def failure_message(code: Column, error: Column) -> Column:
    known = from_map(F.coalesce(code, F.lit("")), FAILURES)
    return F.when(known.isNotNull(), F.concat(known, F.lit(" ("), error, F.lit(")"))).otherwise(F.concat(F.lit("문서 변환에 실패했습니다: "), error))


def fetch_status(reason: Column) -> Column:
    return from_map(reason, FETCH_STATUS).cast("int")


def resolved_input(requests: DataFrame, files: DataFrame, limit: int = MAX_UPLOAD) -> DataFrame:
    """Requests (path, url, base64, filename) with source, content and error: a path wins over a URL over inline bytes.

    ``files``: location and content of what paths and URLs name. A request that can't be served is a row with an error.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    source = F.when(given("path"), "path").when(given("url"), "url").when(given("base64"), "base64")
    located = requests.withColumns({"source": source, "_at": F.when(given("path"), F.col("path")).when(given("url"), F.col("url"))})
    known = files.select(F.col("location").alias("_at"), F.col("content").alias("_content"))
    joined = located.join(known, "_at", "left").withColumn("content", F.when(F.col("source") == "base64", F.try_to_binary("base64", F.lit("base64"))).otherwise(F.col("_content")))
    error = (
        F.when(F.col("source").isNull(), "no-input").when(F.col("content").isNull(), F.when(F.col("source") == "base64", "bad-base64").otherwise("not-found"))
        .when(F.octet_length("content") == 0, "empty").when(F.octet_length("content") > limit, "too-large")
    )
    return joined.withColumn("error", error).withColumn("content", F.when(F.col("error").isNull(), F.col("content"))).drop("_at", "_content")


def pdf_warnings(markdown: Column, kind: Column, ocr_pages: Column) -> Column:
    """What a reader is told about a PDF: no text at all, or pages that are images."""
    some = F.concat(F.lit("일부 페이지("), ocr_pages.cast("string"), F.lit("쪽)가 이미지로만 구성되어 해당 텍스트가 누락될 수 있습니다."))
    return F.when(~has_text(markdown), "no-text").when((kind != "TextBased") & (ocr_pages > 0), some)


def result_json(markdown: Column, fmt: Column, elapsed: Column, images: Column, path: Column, warnings: Column, hidden: Column) -> Column:
    """A result as one JSON object; empty warnings and exclusions are left out."""
    fields = F.struct(markdown.alias("markdown"), fmt.alias("format"), elapsed.alias("elapsed"), images.alias("imageCount"), path.alias("outputPath"), F.when(F.size(warnings) > 0, warnings).alias("warnings"), hidden.alias("hiddenExcluded"))
    return F.to_json(fields)


def reveal_folder(output: Column, selected: Column) -> Column:
    """The folder to show: the output folder, else the selected file's; null where there is none."""
    folder = F.regexp_extract(selected, r"^(.*)[/\\][^/\\]*\z", 1)
    own = F.when(folder != "", folder).when(selected.startswith("/"), "/")
    return F.when(F.coalesce(output, F.lit("")) != "", output).when(selected.isNotNull() & ~is_http_url(selected), own)


def folder_scan(files: DataFrame, root: str, path: str = "path", depth: int = MAX_DEPTH, most: int = MAX_FILES) -> DataFrame:
    """Documents below a folder in order of name: no dot names, at most ``depth`` folders down, the first ``most``.

    The limit is part of the operator: it lists what a reader is shown. Adds group_dir, the folder named from the root.
    """
    top = root.rstrip("/")
    relative = F.substring(F.col(path), F.lit(len(top) + 2), F.length(path))
    base = top.rsplit("/", 1)[-1]
    inside = files.where(F.col(path).startswith(top + "/")).withColumn("_rel", relative)
    shown = inside.where(~F.col("_rel").rlike(r"(^|/)\.") & (F.size(F.split("_rel", "/")) - 1 <= depth) & accepted(F.col("_rel"), "app"))
    folder = F.regexp_extract("_rel", r"^(.*)/[^/]*\z", 1)
    return shown.withColumn("group_dir", F.when(folder == "", base).otherwise(F.concat(F.lit(base + "/"), folder))).orderBy(F.split("_rel", "/")).limit(most).drop("_rel")


def sheet_html(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Visible cells (row, col, text, href, row_span, col_span, covered, col_hidden) as one HTML table a sheet."""
    text = F.regexp_replace(html_escape(F.col("text"), quotes=True), "\r?\n", "<br>")
    href = html_escape(F.col("href"), quotes=True)
    content = F.when(F.col("href").isNull(), text).otherwise(F.concat(F.lit('<a href="'), href, F.lit('">'), F.when(text == "", href).otherwise(text), F.lit("</a>")))
    tag = F.when(F.col("row") == 0, "th").otherwise("td")
    spans = F.concat(*[F.when(F.col(c) > 1, F.concat(F.lit(f' {a}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("") for c, a in (("col_span", "colspan"), ("row_span", "rowspan"))])
    css = F.when(F.col("col_hidden"), ' class="xlsx-hidden-col"').otherwise("")
    cell = F.concat(F.lit("<"), tag, spans, css, F.lit(">"), content, F.lit("</"), tag, F.lit(">"))
    rows = cells.where(~F.col("covered")).groupBy(*keys, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", cell.alias("h")))), lambda x: x["h"]), "").alias("_r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "_r"))), lambda x: F.concat(F.lit("<tr>"), x["_r"], F.lit("</tr>"))), "")
    return rows.groupBy(*keys).agg(F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))


def parse_pipe_tables(documents: DataFrame, doc: list[str], text: str = "markdown") -> DataFrame:
    """Cells of the pipe tables in Markdown: doc, table (from 0), row, col, text; separators are left out."""
    lines = explode_lines(documents.select(*doc, text), text)
    w = Window.partitionBy(*doc).orderBy("line")
    marked = lines.withColumn("_in", F.col("raw").rlike(r"^\s*\|.*\|\s*\z"))
    marked = marked.withColumn("_start", F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)))
    rows = marked.withColumn("table", F.count_if("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).where("_in").withColumn("_t", F.trim("raw"))
    body = rows.where(~F.col("_t").rlike(r"^\|(\s*:?-+:?\s*\|)+\z"))
    ranked = body.withColumn("row", F.row_number().over(Window.partitionBy(*doc, "table").orderBy("line")) - 1)
    parts = F.split("_t", r"(?<!\\)\|")
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return ranked.select(*doc, "table", "row", F.posexplode(inner).alias("col", "_c")).select(*doc, "table", "row", "col", F.trim("_c").alias("text"))


def used_images(references: DataFrame, images: DataFrame, doc: list[str]) -> DataFrame:
    """Image of each reference (ref, seq), by whole name or stem. Every reference gets its image, the first use is marked."""
    stem = F.regexp_replace("name", r"\.[^.]+\z", "")
    keys = images.withColumn("ref", F.explode(F.array_distinct(F.array("name", stem)))).groupBy(*doc, "ref").agg(F.min("name").alias("name"))
    found = references.join(keys, [*doc, "ref"])
    return found.withColumn("first_use", F.row_number().over(Window.partitionBy(*doc, "name").orderBy("seq")) == 1)


def segments(documents: DataFrame, doc: list[str], body: str = "paragraphs", depth: int = 5, controls: int = 4) -> DataFrame:
    """Text index of nested documents: body paragraphs, then cells of their tables, then tables in those cells.

    ``paragraphs``: array of (text, cells array of (row, col, paragraphs of the next level ...)) to ``depth`` levels, each
    exploded in turn, so that no recursion is needed. At most ``controls`` cells' tables of a paragraph are entered below
    the first level. A segment's locator names its way: "b3/c0.1/p0".
    """
    level = documents.select(*doc, F.posexplode(body).alias("_k", "_p"), F.lit("").alias("_at"))
    level = level.select(*doc, F.concat("_at", F.lit("b"), F.col("_k").cast("string")).alias("locator"), "_p")
    out = level.select(*doc, "locator", F.col("_p.text").alias("text"))
    for k in range(depth):
        fields = {f.name for f in level.schema["_p"].dataType.fields}
        if "cells" not in fields:
            break
        entered = F.col("_p.cells") if k == 0 else F.slice("_p.cells", 1, controls)
        cells = level.select(*doc, "locator", F.explode(entered).alias("_c"))
        paragraphs = cells.select(*doc, F.concat("locator", F.lit("/c"), F.col("_c.row").cast("string"), F.lit("."), F.col("_c.col").cast("string")).alias("locator"), F.posexplode("_c.paragraphs").alias("_k", "_p"))
        level = paragraphs.select(*doc, F.concat("locator", F.lit("/p"), F.col("_k").cast("string")).alias("locator"), "_p")
        out = out.unionByName(level.select(*doc, "locator", F.col("_p.text").alias("text")))
    return out


def by_locale(rows: DataFrame, name: str, locale: str = "ko") -> DataFrame:
    """In the order of a locale's collation."""
    return rows.orderBy(F.collate(F.col(name), locale), name)
