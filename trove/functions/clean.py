"""Cleaning expressions used at ingest (Column -> Column, all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A tag is "<" then the shortest run of non-newline characters
# then ">" (Python's '.' stops only at '\n'); white space stripped at both
# ends is the set Python's strip() removes.
TAG_PATTERN = r"<[^\n]*?>"
# Accepted date layouts, tried in this order.
DATE_FORMATS = ("yyyy-M-d", "yyyy", "M/d/yyyy", "d/M/yyyy")


EDGE_SPACE_CHARS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
                    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# Fixed value: texts that Python's float() reads as a number.
FLOAT_PATTERN = (r"^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
                 r"|^[+-]?(?i:inf|infinity|nan)$")


def py_strip(c: Column) -> Column:
    """Strip leading/trailing white space like Python's ``str.strip`` (the
    set above; ``btrim`` with a character set, no regex)."""
    return F.btrim(c, F.lit(EDGE_SPACE_CHARS))


def strip_html(c: Column) -> Column:
    """Remove tags, then strip; NULL or '' gives ''."""
    return F.coalesce(py_strip(F.regexp_replace(c, TAG_PATTERN, "")), F.lit(""))


def safe_float(c: Column) -> Column:
    """NULL, '' or unparsable -> NULL; numbers pass through (digits grouped by
    single underscores too, type suffixes like '5d' not)."""
    s = py_strip(c.cast("string"))
    return F.when(s.rlike(FLOAT_PATTERN), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))


def safe_list(c: Column) -> Column:
    """Array of strings: NULL -> [], elements trimmed, blanks dropped."""
    arr = F.coalesce(c, F.array().cast("array<string>"))
    return F.filter(F.transform(arr, lambda x: py_strip(x)), lambda x: x.isNotNull() & (x != ""))


def safe_list_json(raw: Column) -> Column:
    """``safe_list`` for a JSON value that may be a list, a scalar or null.

    ``raw`` is the field read as a JSON string (``get_json_object`` keeps the
    text of arrays). A value starting with '[' is parsed as an array;
    anything else becomes a one-element list.
    """
    t = F.trim(raw)
    as_arr = F.from_json(t, "array<string>")
    scalar = F.when(t.isNull() | (t == "") | (t == "null") | (t == '""'), F.array().cast("array<string>")) \
        .otherwise(F.array(F.regexp_replace(t, r'^"(.*)"$', "$1")))
    return safe_list(F.when(F.startswith(t, F.lit("[")), as_arr).otherwise(scalar))


def parse_date_multi(c: Column) -> Column:
    """First of the accepted layouts that parses; else NULL."""
    s = F.trim(c.cast("string"))
    parsed = [F.try_to_date(s, fmt) for fmt in DATE_FORMATS]
    return F.coalesce(*parsed)


def trim_default(c: Column) -> Column:
    """Missing -> '', stripped."""
    return py_strip(F.coalesce(c.cast("string"), F.lit("")))


def prefer_local(local: Column, url: Column) -> Column:
    """Local file path when present, else a non-empty URL."""
    return F.coalesce(local, F.nullif(url, F.lit("")))


def prefer_local_list(local: Column, urls: Column) -> Column:
    """Local list if it has elements, else the URL list."""
    return F.when(F.size(F.coalesce(local, F.array())) > 0, local).otherwise(urls)


def truthy_id(c: Column) -> Column:
    return c.isNotNull() & (c != 0)
