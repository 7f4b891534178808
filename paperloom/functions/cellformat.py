"""Spreadsheet number and date formats: classify a code and render a raw value as a reader sees it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exact import fixed, packed_number
from .text import from_map, once

# Built-in format codes (ECMA-376 18.8.30), without those that depend on the locale.
BUILTIN = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm",
    17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)",
    38: "#,##0 ;(#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;(#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0",
    48: "##0.0E+0", 49: "@",
}
# Error literals by the code in a binary workbook.
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
#: Days from 1899-12-30 to 1970-01-01, and between the two calendars of workbooks.
EPOCH, CALENDAR_1904, DAY_MS = 25569, 1462, 86_400_000
NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"


def format_code(format_id: Column, custom: Column | None = None) -> Column:
    """The code of an id: the workbook's own, else the built-in one, else null."""
    built_in = from_map(format_id.cast("string"), {str(k): v for k, v in BUILTIN.items()})
    return built_in if custom is None else F.coalesce(custom, built_in)


def strip_literals(code: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(code, '"[^"]*"', ""), r"\[[^\]]*\]", "")
    return F.regexp_replace(x, r"\\.", "")


def first_section(code: Column) -> Column:
    return F.regexp_extract(code, r"(?s)^([^;]*)", 1)


def classify(code: Column) -> Column:
    def kind(x: Column) -> Column:
        return F.when(x.rlike("[ymdhs]"), F.when(x.rlike("[hs]"), "datetime").otherwise("date")).when(x.contains("%"), "percent").when(x.rlike("[#0]"), "number").otherwise("general")

    return F.when(code.isNull(), "general").otherwise(once(F.lower(strip_literals(code)), kind))


def serial_to_text(serial: Column, date1904: Column, with_time: Column) -> Column:
    """Date of a day serial; null if negative, not finite or past the year 9999. Serials under 60 are off by a day."""
    days = F.when(date1904, serial + CALENDAR_1904).when(serial < 60, serial + 1).otherwise(serial)
    usable = (serial >= 0) & ~F.isnan(serial) & (days < 2958466)
    ms = F.floor(F.when(usable, days - EPOCH) * DAY_MS + 0.5).cast("long")
    at = F.timestamp_millis(ms)
    return F.when(with_time, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def decimal_places(code: Column) -> Column:
    """Digits after the first dot of the first section; exponent digits count too."""
    after = F.regexp_extract(strip_literals(first_section(code)), r"(?s)\.(.*)\z", 1)
    return F.length(F.regexp_replace(after, "[^0#]", ""))


def has_thousands(code: Column) -> Column:
    return strip_literals(first_section(code)).rlike("[#0],[#0]")


def affixes(code: Column) -> tuple[Column, Column]:
    """Literal text before the first and after the last digit place of the first section."""
    section = first_section(code)

    def plain(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, r"\[[^\]]*\]", ""), '"([^"]*)"', "$1")
        return F.trim(F.regexp_replace(F.regexp_replace(x, r"\\(.)", "$1"), "[*_]", ""))

    def unless_bare(x: Column) -> Column:
        return F.when(x == "", x).otherwise(plain(x))

    return once(F.regexp_extract(section, r"(?s)^([^#0]*)[#0]", 1), unless_bare), once(F.regexp_extract(section, r"(?s)[#0]([^#0]*)\z", 1), unless_bare)


def grouped(digits: Column) -> Column:
    return F.regexp_replace(digits, r"\B(?=(\d{3})+(?!\d))", ",")


def format_number(value: Column, code: Column, rounded: Column | None = None) -> Column:
    """sign, prefix, digits, suffix. ``rounded``: the absolute value's digits if they're made otherwise."""
    prefix, suffix = affixes(code)

    def split(body: Column) -> Column:
        whole, rest = F.substring_index(body, ".", 1), F.when(body.contains("."), F.concat(F.lit("."), F.substring_index(body, ".", -1))).otherwise("")
        return F.concat(F.when(has_thousands(code), grouped(whole)).otherwise(whole), rest)

    digits = once(fixed(F.abs(value), decimal_places(code)) if rounded is None else rounded, split)
    return F.concat(F.when(value < 0, "-").otherwise(""), prefix, digits, suffix)


def format_cell(raw: Column, code: Column, date1904: Column) -> Column:
    """A raw cell text as its format shows it; whatever can't be read as a number stays as it is."""

    def by_kind(v: Column) -> Column:
        kind, value = v["kind"], v["value"]
        date = serial_to_text(value, date1904, kind == "datetime")
        percent = F.concat(fixed(value * 100, decimal_places(code)), F.lit("%"))
        return F.when(kind.isin("date", "datetime"), date).when(kind == "percent", percent).when(kind == "number", format_number(value, code))

    number = F.when(raw.rlike(NUMERIC), F.trim(raw).try_cast("double"))
    shown = once(F.struct(classify(code).alias("kind"), number.alias("value")), lambda v: F.when(v["value"].isNotNull(), by_kind(v)))
    return F.coalesce(shown, raw)


def error_text(code: Column) -> Column:
    return from_map(code.cast("string"), {str(k): v for k, v in ERRORS.items()}, F.lit("#ERR!"))


def column_number(reference: Column) -> Column:
    """Zero-based column of an A1 reference."""
    letters = F.split(F.upper(F.regexp_extract(reference, r"^\$?([A-Za-z]+)", 1)), "")
    return F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64) - 1


def row_number_of(reference: Column) -> Column:
    return F.regexp_extract(reference, r"(\d+)\z", 1).try_cast("int") - 1


#: A packed number of a binary workbook, integer or the highest bits of a double.
rk_number = packed_number
