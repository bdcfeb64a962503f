"""Link functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lawstrata.functions.text import strip


def drop_query_and_fragment(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)[?#].*$", "")


def absolute(col: Column, base: str) -> Column:
    """A leading ``/`` means the site root; anything else stays."""
    return F.when(F.startswith(col, F.lit("/")), F.concat(F.lit(base.rstrip("/")), col)).otherwise(col)


def compared_link(col: Column, base: str) -> Column:
    """The form in which links are compared: trimmed, without query, fragment, scheme and final slash,
    host in lower case, a leading ``/`` meaning the site root. Null for null, empty and ``javascript:`` links."""
    x = strip(col)
    x = F.when(~F.lower(x).startswith("javascript:"), x)
    x = strip(drop_query_and_fragment(x))
    x = F.when(F.startswith(x, F.lit("//")), F.substring(x, 3, 1 << 30)).otherwise(absolute(x, base))
    x = F.regexp_replace(x, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    x = F.regexp_replace(x, r"/+$", "")
    host = F.substring_index(x, "/", 1)
    return F.nullif(F.concat(F.lower(host), F.substring(x, F.length(host) + 1, F.lit(1 << 30))), F.lit(""))
