"""Image references in Markdown: modes urls, inline, refs and omit, and signed URLs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"!\[([^\]]*)\]\(\./[^)]*?/?([^/)]+)\)"
URL_ONLY = r"(!\[[^\]]*\]\()(?:\./)?[^)\s]*?([^/)\s]+)(\))"


def _pads(key: bytes) -> tuple[bytes, bytes]:
    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hexadecimal HMAC of a text under a constant key, of two nested digests."""
    inner, outer = (F.unhex(F.lit(p.hex())) for p in _pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def signature(key: bytes, conversion: Column, name: Column, expires: Column) -> Column:
    return hmac_sha256(key, F.concat_ws(":", conversion, name, expires.cast("string")))


def verify(key: bytes, conversion: Column, name: Column, expires: Column, given: Column, now: Column) -> Column:
    good = signature(key, conversion, name, expires) == given
    return F.when(expires <= now, "expired").when(F.coalesce(good, F.lit(False)), "ok").otherwise("invalid")


def signed_url(key: bytes, conversion: Column, name: Column, expires: Column, base: str = "") -> Column:
    path = F.concat(F.lit(f"{base}/v1/images/"), conversion, F.lit("/"), name)
    return F.concat(path, F.lit("?exp="), expires.cast("string"), F.lit("&sig="), signature(key, conversion, name, expires))


#: An image reference, and what stands before its target.
REFERENCE, LEAD = r"!\[[^\]]*\]\([^)\s]*\)", r"^(!\[[^\]]*\]\()"


def rewritten(markdown: Column, replacements: Column) -> Column:
    """References whose file name, what stands behind the last slash, is a key of the map (name -> URL) point to the URL.

    Each reference is looked up once: a URL that looks like another key isn't rewritten again.
    """

    def pointed(reference: Column) -> Column:
        url = F.try_element_at(replacements, F.regexp_extract(reference, r"([^/(]*)\)\z", 1))
        return F.when(url.isNull(), reference).otherwise(F.concat(F.regexp_extract(reference, LEAD, 1), url, F.lit(")")))

    between = F.split(markdown, REFERENCE, -1)
    found = F.concat(F.transform(F.regexp_extract_all(markdown, F.lit(REFERENCE), 0), pointed), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, found, lambda x, y: F.concat(x, y)), "")


def as_refs(markdown: Column, conversion: Column) -> Column:
    return F.regexp_replace(markdown, F.lit(r"(!\[[^\]]*\]\()\./[^)/]*/([^)]+)\)"), F.concat(F.lit("$1conv://"), conversion, F.lit("/images/$2)")))


def omitted(markdown: Column) -> Column:
    """A placeholder with the alternative text, or without where that is blank."""
    blank = F.regexp_replace(markdown, r"!\[\s*\]\([^)]*\)", "_[이미지]_")
    return F.regexp_replace(blank, r"!\[\s*([^\]]*?)\s*\]\([^)]*\)", "_[이미지: $1]_")


def too_large(images: Column, limit_kb: int) -> Column:
    """Names of the images (structs name, size) that exceed the limit: any fails the request."""
    return F.transform(F.filter(images, lambda x: x["size"] > limit_kb * 1024), lambda x: x["name"])


def data_uri(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(data))


def inlined(html: Column, images: Column) -> Column:
    """A page for viewing on its own: sources that name an image (structs name, mime, data) become data URIs."""
    return F.aggregate(images, html, lambda h, i: F.replace(h, F.concat(F.lit('src="'), i["name"], F.lit('"')), F.concat(F.lit('src="'), data_uri(i["mime"], i["data"]), F.lit('"'))))
