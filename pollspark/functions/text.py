"""Text expressions. All are built-in JVM expressions; no Python runs per row."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pollspark import dims


def blank_to_null(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(~t.isin("", "–"), t)


def header_name(text: Column) -> Column:
    """Clean a column header: one blank between words, one name for the union, no marks."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    t = (
        F.when(t.contains("CDU") & t.contains("CSU"), F.lit("CDU/CSU"))
        .when(t == "", F.lit("Empty"))
        .otherwise(t)
    )
    return F.regexp_replace(t, r"(?U)[^\w\s/]", "")


# Fixed value: shape of a percentage in a table cell.
PERCENT_PATTERN = r"(?U)\d+(?:,\d+)?\s*%"


def percent_value(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?U)\s*%|^\s+|\s+$", "")
    return F.replace(bare, F.lit(","), F.lit(".")).try_cast("double")


def mode_code(text: Column) -> Column:
    """First run of letters; empty where there is none."""
    return F.coalesce(F.regexp_extract(text, r"([A-Za-z]+)", 1), F.lit(""))


def survey_method(text: Column) -> Column:
    code = F.regexp_extract(text, r"^[A-Za-z]+", 0)
    return dims.map_lookup(dims.METHOD_MAP, code, F.lit("unknown"))


def sample_size(text: Column) -> Column:
    """``2.004`` -> 2004, ``?.500`` -> 1500, ``?`` -> 0; no digits -> null, row by row."""
    t = F.regexp_extract(text, r"([\d.?]+)", 1)
    for old, new in (("?.", "1"), ("?", "0"), (".", "")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return t.try_cast("int")


def number_text(x: Column) -> Column:
    """A number as the shortest decimal of 15 significant digits: ``6``, ``36.3``, ``0.05``.

    Meant for percentages, below 100 in size; ids depend on this text, so it must not change.
    """
    fixed = x.cast("double").cast("decimal(28,13)").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")


def indexed_name(name: Column) -> tuple[Column, Column, Column]:
    """``pi[12,3]`` -> ``pi``, 12, 3."""
    shape = r"^([^\[]+)\[(\d+),(\d+)\]$"
    base = F.regexp_extract(name, shape, 1)
    return (
        base,
        F.regexp_extract(name, shape, 2).try_cast("int"),
        F.regexp_extract(name, shape, 3).try_cast("int"),
    )


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def parent_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def safe_name(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("_"))


_REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


_NAMES = json.dumps({**name2codepoint, "apos": 39})  # one constant, which the optimizer turns into a map


def _character(reference: Column) -> Column:
    """``#252``, ``#xFC`` or ``uuml`` as its character; null where there is none."""
    named = F.try_element_at(F.from_json(F.lit(_NAMES), "map<string, int>"), reference)
    code = F.when(reference.rlike("^#[xX]"), F.conv(F.substring(reference, 3, 6), 16, 10).cast("int")) \
        .when(reference.startswith("#"), F.substring(reference, 2, 7).cast("int")).otherwise(named)
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def unescaped(html: Column) -> Column:
    """The character references of HTML text as characters: numbers, and the names of HTML 4 with ``apos``.

    Each distinct reference of a text is replaced once, ampersands last, so no text is decoded twice. Others stay.
    """
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(_REFERENCE), F.lit(1)))
    ampersand = lambda r: F.coalesce(_character(r) == "&", F.lit(False))
    order = F.concat(F.filter(found, lambda r: ~ampersand(r)), F.filter(found, ampersand))
    decoded = F.aggregate(order, html, lambda text, r: F.coalesce(F.replace(text, F.concat(F.lit("&"), r, F.lit(";")), _character(r)), text))
    return F.when(html.contains("&"), decoded).otherwise(html)


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve ``href`` against ``base``: absolute, scheme-relative, root-relative, relative."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page == site, F.concat(site, F.lit("/"))).otherwise(
        F.regexp_extract(page, r"^(.*/)", 1))
    joined = F.concat(folder, F.regexp_replace(href, r"^(\./)+", ""))
    for _ in range(4):
        joined = F.regexp_replace(joined, r"(?<=[^/:])/[^/]+/\.\./", "/")
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .otherwise(joined)
    )
