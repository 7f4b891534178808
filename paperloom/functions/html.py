"""Columns of HTML: native expressions where text suffices, tree functions over Arrow batches else."""

from __future__ import annotations

import codecs
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import markup
from .text import by_row, html_escape


def unescaped(x: Column) -> Column:
    """The five predefined entities."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def title(html: Column) -> Column:
    return unescaped(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def drop_dangerous(html: Column) -> Column:
    """Paired and void active elements by pattern; sanitized() does the same on the tree, with attributes."""
    paired = "|".join(rf"<{t}[\s>].*?</{t}\s*>" for t in ("script", "style", "noscript"))
    return F.regexp_replace(F.regexp_replace(html, f"(?is){paired}", ""), r"(?i)<(?:link|meta)(?:\s[^>]*)?>", "")


def with_heading(html: Column, heading: Column) -> Column:
    return F.when(html.rlike(r"(?i)<h1[\s>]") | heading.isNull(), html).otherwise(F.concat(F.lit("<h1>"), html_escape(heading), F.lit("</h1>"), html))


def absolute_links(html: Column, url: Column) -> Column:
    """Root-relative links made absolute; the tree function resolves all kinds."""
    origin = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    return F.regexp_replace(html, F.lit(r'(?i)(href|src)="/([^/"][^"]*)?"'), F.concat(F.lit('$1="'), origin, F.lit('/$2"')))


def with_base(html: Column, url: Column) -> Column:
    """A base element at the start of the first head, unless there is one."""
    based = F.regexp_replace(html, F.lit(r"(?i)^(.*?<head[^>]*>)"), F.concat(F.lit('$1<base href="'), url, F.lit('">')))
    return F.when(html.rlike(r"(?i)<base[\s>]"), html).otherwise(based)


def decode_bytes(content: bytes, content_type: str | None) -> str:
    """Charset of the header, else of the first 2048 bytes' meta element, else UTF-8; unknown labels mean UTF-8."""
    label = re.search(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", content_type or "")
    label = label or re.search(r"(?i)<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)", content[:2048].decode("latin-1"))
    name = label[1].lower() if label else "utf-8"
    try:
        codecs.lookup(name := {"ks_c_5601-1987": "cp949", "euc-kr": "cp949"}.get(name, name))
    except LookupError:
        name = "utf-8"
    return content.decode(name, "replace").removeprefix("\ufeff")


@F.arrow_udf(StringType())
def decoded(content: pa.Array, content_type: pa.Array) -> pa.Array:
    return by_row(lambda c, t: None if c is None else decode_bytes(c, t), pa.string(), content, content_type)


@F.arrow_udf(StringType())
def main_content(html: pa.Array) -> pa.Array:
    return by_row(lambda x: None if x is None else markup.to_html(markup.content(markup.parse(x))[0]), pa.string(), html)


@F.arrow_udf(StringType())
def sanitized(html: pa.Array, base: pa.Array) -> pa.Array:
    return by_row(lambda h, b: None if h is None else markup.to_html(markup.sanitize(markup.parse(h), b)), pa.string(), html, base)


@F.arrow_udf(StringType())
def to_markdown(html: pa.Array) -> pa.Array:
    return by_row(lambda x: None if x is None else markup.to_markdown(markup.parse(x)), pa.string(), html)


@F.arrow_udf(StringType())
def page_markdown(html: pa.Array, url: pa.Array) -> pa.Array:
    return by_row(lambda h, u: None if h is None else markup.page_to_markdown(h, u), pa.string(), html, url)


def frame_target(html: Column) -> Column:
    """Source of the frame that a shell page shows: body text under 200 characters; a frame named main is preferred."""
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[\s>].*?</script\s*>|<title.*?</title\s*>|<style.*?</style\s*>", ""), "<[^>]*>", "")
    named = F.regexp_extract(html, r"""(?is)<i?frame(?=[^>]*(?:id|name)\s*=\s*["']?[^"'>\s]*main)[^>]*?src\s*=\s*["']?([^"'>\s]+)""", 1)
    first = F.regexp_extract(html, r"""(?is)<i?frame[^>]*?src\s*=\s*["']?([^"'>\s]+)""", 1)
    found = F.when(named != "", named).otherwise(first)
    return F.when((F.length(F.trim(body)) < 200) & (found != "") & ~found.rlike(r"(?i)^(?!https?:)[a-z][a-z0-9+.-]*:"), found)
