"""Text scalars: glyph repair, escaping, slugs, inline Markdown, image names and references."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Symbol-font code points (U+F000 to U+F0FF) and the characters they stand for.
PUA_SYMBOLS = {
    61474: "✂", 61494: "⌛", 61509: "☜", 61510: "☞", 61511: "☝", 61512: "☟", 61514: "☺", 61518: "☠", 61522: "☼", 61524: "❄",
    61528: "✠", 61529: "✡", 61548: "●", 61549: "○", 61550: "■", 61551: "□", 61552: "□", 61553: "□", 61554: "□", 61555: "◇",
    61556: "◆", 61557: "◆", 61558: "❖", 61559: "◆", 61598: "·", 61599: "•", 61600: "·", 61601: "○", 61602: "○", 61603: "○",
    61604: "◉", 61605: "◎", 61607: "▪", 61608: "□", 61610: "✦", 61611: "★", 61612: "✶", 61613: "✴", 61614: "✹", 61623: "•",
    61656: "➢", 61672: "➔", 61679: "⇦", 61680: "⇨", 61681: "⇧", 61682: "⇩", 61691: "✗", 61692: "✓", 61693: "☒", 61694: "☑",
}
# Code points of the supplementary private-use plane 15, as (code point, code point it stands for).
PLANE_15 = {
    983049: 0x23AC, 983050: 0x239B, 983052: 0x23A7, 983054: 0x23A1, 983062: 0x239D, 983064: 0x23A9, 983066: 0x23A3,
    983117: 0x268C, 983125: 0x266C, 983135: 0x266A, 983291: 0x3280, 983447: 0x25CF, 983448: 0x25CF, 983688: 0x24EA,
    983787: 0x25FB, 983790: 0x29EB, 983791: 0x25C6, 983792: 0x25B5, 983793: 0x25B4, 983794: 0x25B2, 983795: 0x25BD,
    983796: 0x25BF, 983797: 0x25BC, 983798: 0x25C3, 983799: 0x25C1, 983800: 0x25C0, 983801: 0x25B9, 983802: 0x25B7,
    983803: 0x25B8, 983804: 0x25B6, 983805: 0x25C0, 983806: 0x25B2, 983807: 0x25BC, 983835: 0x20E6, 983836: 0x20E6,
    983857: 0x2AFC, 984219: 0x00B9, 984222: 0x2074, 984229: 0x00B9, 984232: 0x2074, 984320: 0x2395, 984321: 0x20E6,
    984751: 0x2395, 985090: 0x20ED, 985091: 0x20ED, 985094: 0x250E, 985095: 0x22A4, 985097: 0x2520, 985098: 0x2064,
    985100: 0x2516, 985101: 0x22A5, 985103: 0x2500, 985114: 0x20E6, 985115: 0x20E6, 985144: 0x256A, 985147: 0x2567,
    985160: 0x2500,
}
# Glyphs that stand for the same symbol, and the one that is used here.
CANONICAL_GLYPHS = {"◻": "□", "❑": "□", "✔": "✓", "✘": "✗", "⚪": "○", "⚫": "●", "⬧": "◇", "⬥": "◆", "⧫": "◆"}
# Media types by file extension, and the extension of each type.
MIME_BY_EXTENSION = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".tiff": "image/tiff", ".tif": "image/tiff", ".svg": "image/svg+xml", ".webp": "image/webp", ".emf": "image/emf", ".wmf": "image/wmf"}
EXTENSION_BY_MIME = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/svg+xml": ".svg", "image/webp": ".webp", "image/emf": ".emf", "image/wmf": ".wmf"}
# Names of styles and the heading level each means; line shapes that strike text out.
STYLE_LEVELS = [(r"^1\.\s*제목\z", 1), (r"^1\.1\s*부제목\z", 2), (r"^부제목2\z", 2), (r"^1\.1\.1\s*소제목\z", 3)]
LIST_STYLE = "나열"
STRIKE_SHAPES = "SOLID DOT DASH DASH_DOT DASH_DOT_DOT LONG_DASH CIRCLE DOUBLE_LINE DOUBLE_SLIM_LINE SLIM_THICK_LINE THICK_SLIM_LINE SLIM_THICK_SLIM_LINE".split()
#: Zero-width space, non-joiner, joiner and byte-order mark.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
# Fixed value: punctuation that anchors leave out.
SLUG_PUNCTUATION = r"""[!"#$%&'()*+,./:;<=>?@\[\\\]^`{|}~]"""
# Fixed value: white space as the source of the documents counts it, spelled out since Java's \s is ASCII only.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# Rewrites of inline Markdown, in order.
INLINE = [(r"`([^`]+)`", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"), (r"~~([^~]+)~~", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1")]


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once, however often it is used."""
    return F.aggregate(F.array(), x, lambda acc, _: acc, use)


def from_map(key: Column, pairs: dict[str, str], default: Column | None = None) -> Column:
    """A literal lookup."""
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, default)


#: Rows of a batch that are Python objects at a time.
AT_A_TIME = 64


def by_row(f: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """f of each row of Arrow columns. A batch stays in Arrow's memory; only a few of its rows at a time are Python objects."""
    parts = [pa.array([f(*row) for row in zip(*(c.slice(at, AT_A_TIME).to_pylist() for c in columns), strict=True)], kind) for at in range(0, len(columns[0]), AT_A_TIME)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(StringType())
def nfc(texts: pa.Array) -> pa.Array:
    return by_row(lambda x: x if x is None else unicodedata.normalize("NFC", x), pa.string(), texts)


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    return by_row(lambda x: x if x is None else unicodedata.normalize("NFKC", x), pa.string(), texts)


def normalize_symbols(text: Column) -> Column:
    """Private-use symbols to Unicode; unknown ones stay."""
    codes = {chr(k): v for k, v in PUA_SYMBOLS.items()} | {chr(k): chr(v) for k, v in PLANE_15.items()}
    return F.translate(text, "".join(codes), "".join(codes.values()))


def canonical_glyphs(text: Column) -> Column:
    return F.translate(text, "".join(CANONICAL_GLYPHS), "".join(CANONICAL_GLYPHS.values()))


def repaired(text: Column) -> Column:
    """Raw run text of a document: symbols, then canonical glyphs."""
    return canonical_glyphs(normalize_symbols(text))


def strip_zero_width(text: Column) -> Column:
    return F.translate(text, ZERO_WIDTH, "")


def mime_of(name: Column) -> Column:
    return from_map(F.regexp_extract(F.lower(name), r"(\.[^.]+)\z", 1), MIME_BY_EXTENSION, F.lit("application/octet-stream"))


def extension_of(mime: Column) -> Column:
    return from_map(mime, EXTENSION_BY_MIME, F.lit(".bin"))


def image_name(index: Column, extension: Column) -> Column:
    dotted = F.when(extension.startswith("."), extension).otherwise(F.concat(F.lit("."), extension))
    return F.concat(F.format_string("img_%03d", index), dotted)


def html_escape(text: Column, quotes: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;")] if quotes else [])
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def prefix_image_refs(markdown: Column, names: Column, folder: Column) -> Column:
    """``](name)`` becomes ``](./folder/name)`` for each of the names."""
    return F.aggregate(names, markdown, lambda md, n: F.replace(md, F.concat(F.lit("]("), n, F.lit(")")), F.concat(F.lit("](./"), folder, F.lit("/"), n, F.lit(")"))))


def warning_text(page: Column, message: Column) -> Column:
    return F.when(page.isNotNull(), F.concat(page.cast("string"), F.lit("쪽: "), message)).otherwise(message)


def slugify(text: Column, ascii_only: bool = False) -> Column:
    """Anchor of a heading. ASCII-only text needs no compatibility normalisation, so it stays in the JVM."""
    x = text if ascii_only else nfkc(text)
    x = F.regexp_replace(F.regexp_replace(x, f"{SPACE}+", "-"), SLUG_PUNCTUATION, "")
    return F.lower(F.regexp_replace(F.regexp_replace(x, "-+", "-"), r"^-+|-+\z", ""))


def strip_inline(text: Column) -> Column:
    for pattern, keep in INLINE:
        text = F.regexp_replace(text, pattern, keep)
    return text


def safe_temp_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\w.\-가-힣]", "_")


def safe_image_name(name: Column, mime: Column) -> Column:
    safe = F.regexp_replace(name, r"[^\w.-]", "_")
    return F.when(safe.rlike(r"\.[^.]+\z"), safe).otherwise(F.concat(safe, extension_of(mime)))


def style_level(style: Column) -> Column:
    level = F.lit(None).cast("int")
    for pattern, n in reversed(STYLE_LEVELS):
        level = F.when(style.rlike(pattern), n).otherwise(level)
    return level


def is_list_style(style: Column) -> Column:
    return style.startswith(LIST_STYLE)


def is_struck(present: Column, shape: Column) -> Column:
    """A strike mark counts if it has no shape or a shape that draws a line."""
    return present & (shape.isNull() | shape.isin(STRIKE_SHAPES))


def has_text(markdown: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(markdown, r"(?s)<!--.*?-->", ""), f"{SPACE}+", "") != ""


def leaders_and_bullets(text: Column) -> Column:
    """Runs of leader dots become a dash, a stray bullet code a bullet."""
    x = F.regexp_replace(text, r"\s*[·.]{4,}\s*", " — ")
    return F.regexp_replace(x, r"Ÿ\s?", "• ")


def trim_edges(line: Column) -> Column:
    """No white space at the end, exactly one leading space less."""
    x = F.regexp_replace(line, f"{SPACE}+\\z", "")
    return F.when(x.startswith(" "), F.substr(x, F.lit(2))).otherwise(x)
