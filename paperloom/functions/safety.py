"""Predicates that guard fetching and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .routing import is_http_url, url_host
from .text import once

#: Blocked IPv4 ranges (first address, bits of prefix).
BLOCKED_V4 = [("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("198.18.0.0", 15), ("224.0.0.0", 4), ("240.0.0.0", 4)]
V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\z"
MAX_BYTES, MAX_REDIRECTS = 20 * 1024 * 1024, 3


def v4_number(ip: Column) -> Column:
    """The address as a long, null if it isn't dotted quad."""

    def number(parts: Column) -> Column:
        valid = F.forall(parts, lambda p: p <= 255)
        return F.when(valid, F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p))

    parts = F.transform(F.split(ip, r"\."), lambda p: p.cast("long"))
    return F.when(ip.rlike(V4), once(parts, number))


def blocked_v4(number: Column) -> Column:
    def test(n: Column) -> Column:
        out = F.lit(False)
        for first, bits in BLOCKED_V4:
            a, b, c, d = map(int, first.split("."))
            low = ((a * 256 + b) * 256 + c) * 256 + d
            out = out | n.between(low, low + (1 << 32 - bits) - 1)
        return out

    return once(number, test)


def is_blocked_ip(ip: Column) -> Column:
    """Private, loopback, link-local, reserved and multicast addresses; whatever isn't an address is blocked too."""
    x = F.lower(F.coalesce(ip, F.lit("")))
    mapped = F.regexp_extract(x, r"^::ffff:(\d+\.\d+\.\d+\.\d+)\z", 1)
    quad = F.when(mapped != "", mapped).otherwise(x)
    v6 = x.contains(":") & x.rlike(r"^[0-9a-f:.]+\z")
    bad6 = x.isin("::", "::1") | x.rlike(r"^f[cd][0-9a-f]{2}:") | x.rlike(r"^fe[89ab][0-9a-f]:") | x.startswith("ff")
    return F.when(quad.rlike(V4), F.coalesce(blocked_v4(v4_number(quad)), F.lit(True))).when(v6 & (mapped == ""), bad6).otherwise(True)


def is_dangerous_uri(uri: Column) -> Column:
    x = F.lower(F.regexp_replace(uri, r"[\x00-\x20]", ""))
    return x.startswith("javascript:") | x.startswith("vbscript:") | (x.startswith("data:") & ~x.startswith("data:image/"))


def is_viewer_uri(uri: Column) -> Column:
    """Schemes that a viewer may follow; relative references have none."""
    x = F.lower(F.regexp_replace(uri, r"[\x00-\x20]", ""))
    scheme = F.regexp_extract(x, r"^([a-z][a-z0-9+.-]*):", 1)
    return (scheme == "") | scheme.isin("http", "https", "data", "blob")


def fetch_verdict(url: Column, addresses: Column) -> Column:
    """Why a URL may not be fetched, or "ok": every address that its host resolves to has to be public."""
    literal = url_host(url).rlike(V4)
    return (
        F.when(~F.coalesce(url.rlike("(?i)^https?:"), F.lit(False)), "unsupported-scheme")
        .when(~is_http_url(url), "invalid-url")
        .when(literal & is_blocked_ip(url_host(url)), "blocked-address")
        .when(~literal & (F.size(addresses) <= 0), "dns-failure")
        .when(~literal & ~F.forall(addresses, lambda x: ~is_blocked_ip(x)), "blocked-address")
        .otherwise("ok")
    )


def response_verdict(content_type: Column, size: Column, redirects: Column, limit: int = MAX_BYTES) -> Column:
    kind = F.lower(F.trim(F.regexp_extract(F.coalesce(content_type, F.lit("text/html")), "^([^;]*)", 1)))
    return F.when(redirects > MAX_REDIRECTS, "too-many-redirects").when(size > limit, "too-large").when(~kind.isin("text/html", "application/xhtml+xml", "text/plain"), "unsupported-content-type").otherwise("ok")
