"""URL parts as native expressions, with the lenient rules of common URL splitters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses that redirect.
REDIRECTS = ("301", "302", "303", "307", "308")


def netloc(url: Column) -> Column:
    """Host with port and user, lower-cased; '' if there is none."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def query_keys(url: Column) -> Column:
    """Number of distinct query keys with a value."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p.rlike("^[^=]*=."))
    return F.size(F.array_distinct(F.transform(pairs, lambda p: F.substring_index(p, "=", 1))))


def normalised(url: Column) -> Column:
    """Without fragment and outer blanks."""
    return F.trim(F.substring_index(url, "#", 1))


def broken(status: Column) -> Column:
    return F.coalesce(status.rlike("^[45]"), F.lit(False))


def redirecting(status: Column) -> Column:
    return F.coalesce(F.substring(status, 1, 3).isin(*REDIRECTS), F.lit(False))


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""
