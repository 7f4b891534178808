"""Where inputs come from and where outputs go: formats, names, paths, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import from_map

# Formats by extension, and the extensions that each surface accepts.
FORMATS = {"hwp": "hwp", "hwpx": "hwpx", "doc": "doc", "docx": "docx", "pdf": "pdf", "xls": "xls", "xlsx": "xlsx", "html": "html", "htm": "html"}
ACCEPTED = {"core": list(FORMATS), "service": "hwp hwpx doc docx pdf xls xlsx".split(), "app": [*FORMATS, "md"]}
#: First bytes of an OLE2 compound file, of a ZIP archive and of two older word-processor formats.
OLE2, ZIP, HWP3 = "D0CF11E0A1B11AE1", "504B0304", "HWP Document File"
HTTP = r"(?i)^https?://[^/?#\s]+"


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([^./\\]+)\z", 1)


def detect_format(path: Column) -> Column:
    """Format of a path, null if unknown (a row's error, not the batch's)."""
    return from_map(extension(path), FORMATS)


def accepted(path: Column, layer: str = "core") -> Column:
    return extension(path).isin(ACCEPTED[layer])


def is_http_url(x: Column) -> Column:
    return F.coalesce(x.rlike(HTTP), F.lit(False))


def resolve_format(path: Column) -> Column:
    return F.when(is_http_url(path), "html").otherwise(detect_format(path))


def sniff(content: Column) -> Column:
    """Container by its first bytes, null if unknown. A ZIP counts as hwpx: xlsx and docx need their extension."""
    head = F.substring(content, 1, 1024)
    hexed, text = F.hex(head), F.decode(head, "ISO-8859-1")
    return F.when(text.startswith(HWP3), "hwp").when(text.rlike(r"(?s)^\s*<\?xml.*<HWPML"), "hwp").when(hexed.startswith(OLE2), "hwp").when(hexed.startswith(ZIP), "hwpx")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*\z", "")


def percent_decoded(x: Column) -> Column:
    """As browsers decode a component: a plus stays; text with a malformed escape stays whole."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def url_slug(url: Column) -> Column:
    """Host and path as a file name of at most 80 characters."""
    raw = F.concat(url_host(url), percent_decoded(url_path(url)))
    slug = F.regexp_replace(F.regexp_replace(raw, r"[^\p{L}\p{N}]+", "_"), r"^_+|_+\z", "")
    return F.when(is_http_url(url) & (slug != ""), F.substring(slug, 1, 80)).otherwise("page")


def url_display(url: Column) -> Column:
    return F.concat(url_host(url), F.regexp_replace(percent_decoded(url_path(url)), r"/\z", ""))


def url_basename(url: Column) -> Column:
    """Last part of a URL's path, percent-decoded; null if empty."""
    return F.nullif(percent_decoded(F.regexp_extract(url_path(url), r"([^/]*)\z", 1)), F.lit(""))


def images_folder(path: Column) -> Column:
    return F.concat(F.when(is_http_url(path), url_slug(path)).otherwise(stem(path)), F.lit("_images"))


def chosen_name(*candidates: Column, layer: str = "service") -> Column:
    """The first candidate of an accepted format, else the first that isn't null."""
    given = F.filter(F.array(*candidates), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(F.filter(given, lambda x: accepted(x, layer)), F.lit(1)), F.try_element_at(given, F.lit(1)))


def disposition_name(header: Column) -> Column:
    """File name of a Content-Disposition header; the UTF-8 form wins, separators and control characters go."""
    star = F.regexp_extract(header, r"(?i)filename\*\s*=\s*utf-8''([^;]+)", 1)
    plain = F.regexp_extract(header, r"""(?i)filename\s*=\s*(?:"([^"]*)"|[^;"\s]+)""", 1)
    bare = F.regexp_extract(header, r"(?i)filename\s*=\s*([^;\"\s]+)", 1)
    name = F.coalesce(F.nullif(percent_decoded(F.trim(star)), F.lit("")), F.nullif(plain, F.lit("")), F.nullif(bare, F.lit("")))
    return F.nullif(F.regexp_replace(F.regexp_replace(remade(name), r"[\x00-\x1f\x7f]", ""), r"[/\\]", "_"), F.lit(""))


def remade(name: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again; other names stay."""
    latin = name.rlike(r"[\x{80}-\x{FF}]") & ~name.rlike(r"[^\x{00}-\x{FF}]")
    text = F.encode(name, "ISO-8859-1").cast("string")
    return F.when(latin, F.when(F.is_valid_utf8(text), text).otherwise(name)).otherwise(name)


def markdown_path(source: Column, folder: Column | None = None) -> Column:
    """Where a source's Markdown goes: the folder, else beside the source (a URL: the working folder)."""
    name = F.concat(F.when(is_http_url(source), url_slug(source)).otherwise(stem(source)), F.lit(".md"))
    own = F.when(is_http_url(source), "").otherwise(F.regexp_extract(source, r"^(.*[/\\])", 1))
    return F.concat(own, name) if folder is None else F.concat(F.regexp_replace(folder, r"/+\z", ""), F.lit("/"), name)


def conflict_path(path: Column, exists: Column, policy: Column) -> Column:
    """overwrite: the path; rename: a free-looking variant; skip: null."""
    renamed = F.regexp_replace(path, r"(\.[^./\\]+)\z", " (1)$1")
    return F.when(~exists | (policy == "overwrite"), path).when(policy == "rename", renamed)


def asset_url(src: Column, base: Column) -> Column:
    """A local reference joined to its document's folder; empty, fragment and absolute ones stay."""
    keep = (src == "") | src.startswith("#") | src.startswith("/") | src.rlike(r"(?i)^[a-z][a-z0-9+.-]*:")
    local = F.regexp_replace(percent_decoded(src), r"^(?:\./)+", "")
    return F.when(keep, src).otherwise(F.concat(F.regexp_replace(base, r"/+\z", ""), F.lit("/"), local))
