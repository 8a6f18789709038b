"""URL columns by the generic syntax of RFC 3986, which takes blanks, ``|`` and any host name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYNTAX = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
SCHEME, AUTHORITY, PATH, QUERY = 1, 2, 3, 4


def part(url: Column, which: int) -> Column:
    """One of scheme, authority, path and query; an absent one is empty."""
    return F.regexp_extract(url, SYNTAX, which)


def host(url: Column) -> Column:
    """The lower-cased host without user and port; null for a url without one."""
    bare = F.regexp_replace(part(url, AUTHORITY), r"^.*@", "")
    return F.nullif(F.lower(F.regexp_replace(bare, r":[0-9]*$", "")), F.lit(""))


def origin(url: Column) -> Column:
    """``scheme://authority`` of a url that has both, else null."""
    return F.when((part(url, SCHEME) != "") & (part(url, AUTHORITY) != ""), F.concat(part(url, SCHEME), F.lit("://"), part(url, AUTHORITY)))


def raw_slug(url: Column) -> Column:
    """The last path segment, trailing slashes aside; empty for a root."""
    return F.element_at(F.split(F.regexp_replace(part(url, PATH), "/+$", ""), "/"), -1)


def slug(url: Column) -> Column:
    return F.lower(F.translate(raw_slug(url), "-_", "  "))


def parameter_names(url: Column) -> Column:
    """Lower-cased names of the query parameters that have a value."""
    pairs = F.filter(F.split(part(url, QUERY), "&"), lambda p: F.instr(p, "=") > 0)
    full = F.filter(pairs, lambda p: F.substring_index(p, "=", 1) != p)
    kept = F.filter(full, lambda p: F.length(p) > F.length(F.substring_index(p, "=", 1)) + 1)
    return F.transform(kept, lambda p: F.lower(F.url_decode(F.regexp_replace(F.substring_index(p, "=", 1), "%(?![0-9A-Fa-f]{2})", "%25"))))


def tracking_only(url: Column) -> Column:
    """A url with ``?`` whose parameters all serve tracking, or that has none."""
    names = parameter_names(url)
    plain = F.forall(names, lambda p: p.startswith("utm") | p.startswith("ref") | (p == "replytocom"))
    return F.contains(url, F.lit("?")) & plain
