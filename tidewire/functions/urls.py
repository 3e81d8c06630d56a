"""URL rules as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def host(url: Column) -> Column:
    """The lower-case host name without user and port; empty for what is no URL."""
    return F.coalesce(F.lower(F.try_parse_url(F.trim(url), F.lit("HOST"))), F.lit(""))


def canonical(url: Column) -> Column:
    """Scheme (https if none) and host in lower case without ``www.``, path without a last slash, no query."""
    url = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("https"))
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.concat(scheme, F.lit("://"), F.regexp_replace(host(url), r"^www\.", ""), path)


def host_allowed(url: Column, base: Column) -> Column:
    """Whether the host is the base's or its twin with or without ``www.``."""
    bare = lambda h: F.regexp_replace(h, r"^www\.", "")
    mine, theirs = host(url), host(base)
    return (mine != "") & (theirs != "") & (bare(mine) == bare(theirs))


def pair_key(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), "␟")
