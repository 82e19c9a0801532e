"""URLs, HTTP statuses, and what requests are made of."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_URL = 8192
# Names of priorities, and status codes for retries.
PRIORITIES = {"URGENT": 200, "HIGH": 100, "NORMAL": 0, "LOW": -100, "BACKGROUND": -200}
RETRY_CODES = (500, 502, 503, 504, 408, 429)
IGNORE_CODES = (400, 401, 403, 404, 410)


def _part(url: Column, part: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit(part)), F.lit(""))


def authority(url: Column, default: str = "unknown") -> Column:
    """Host with port, as it is written."""
    found = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.when(found != "", found).otherwise(F.lit(default))


def domain(url: Column, default: str = "default") -> Column:
    """Lower-case host without port and without www."""
    host = F.substring_index(F.lower(authority(url, "")), ":", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host).otherwise(F.lit(default))


def hostname(url: Column) -> Column:
    """Lower-case host without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(authority(url, ""), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))
    return F.when(host != "", host)


def onsite(url: Column, allowed: list[str]) -> Column:
    """Whether the host is an allowed domain or under one; a URL without host is not. No allowed domains: all are."""
    if not allowed:
        return F.lit(True)
    host = hostname(url)
    fits = [(host == d.lower()) | F.endswith(host, F.lit("." + d.lower())) for d in allowed]
    out = fits[0]
    for f in fits[1:]:
        out = out | f
    return F.coalesce(out, F.lit(False))


def url_problem(url: Column) -> Column:
    """Why a URL can't be fetched, or null: empty, too long, a dangerous scheme, no http or https."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return (
        F.when(F.coalesce(F.trim(url), F.lit("")) == "", "empty")
        .when(F.length(url) > MAX_URL, "too long")
        .when(scheme.isin("javascript", "data", "vbscript", "file"), "dangerous scheme")
        .when(~scheme.isin("http", "https"), "not http")
    )


def _encoded(text: Column) -> Column:
    """Percent-encoding of a form, with ~ left alone as urllib does and * encoded."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def merge_params(url: Column, params: Column, replace: bool = True) -> Column:
    """url with the entries of the map params in its query: they replace or, not replacing, only add. All of the query is encoded anew; the last of a name wins, at the first one's place."""
    query, fragment = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    old = F.transform(parts, lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), F.try_url_decode(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise("").alias("v")))
    new = F.transform(F.map_entries(params), lambda e: F.struct(e["key"].cast("string").alias("k"), e["value"].cast("string").alias("v")))
    both = F.concat(old, F.coalesce(new, F.array().cast("array<struct<k:string,v:string>>")))
    names = F.array_distinct(F.transform(both, lambda e: e["k"]))
    if replace:
        value = lambda n: F.element_at(F.filter(both, lambda e: e["k"] == n), -1)["v"]
    else:
        value = lambda n: F.coalesce(F.try_element_at(F.filter(old, lambda e: e["k"] == n), F.lit(-1))["v"], F.try_element_at(F.filter(new, lambda e: e["k"] == n), F.lit(-1))["v"])
    merged = F.array_join(F.transform(names, lambda n: F.concat(_encoded(n), F.lit("="), _encoded(value(n)))), "&")
    out = F.concat(base, F.when(merged != "", F.concat(F.lit("?"), merged)).otherwise(""), fragment)
    return F.when(F.size(params) > 0, out).otherwise(url)


def escape_ajax(url: Column) -> Column:
    """#!x becomes the parameter _escaped_fragment_; other URLs stay."""
    fragment = F.regexp_extract(url, r"#!(.*)$", 1)
    out = merge_params(F.regexp_replace(url, r"#.*$", ""), F.create_map(F.lit("_escaped_fragment_"), fragment))
    return F.when(F.rlike(url, F.lit(r"^[^#]*#!")), out).otherwise(url)


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, query sorted by name and value with blanks kept, both re-encoded, no fragment, / for an empty path."""
    scheme, rest = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)), F.lower(authority(url, ""))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(pairs, lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), F.try_url_decode(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise("").alias("v")))
    sorted_ = F.array_join(F.transform(F.array_sort(pairs), lambda e: F.concat(_encoded(e["k"]), F.lit("="), _encoded(e["v"]))), "&")
    out = F.concat(scheme, F.lit("://"), rest, F.when(path == "", "/").otherwise(path), F.when(sorted_ != "", F.concat(F.lit("?"), sorted_)).otherwise(""))
    return F.when(F.rlike(url, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*://")), out).otherwise(url)


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, url: pd.Series) -> pd.Series:
    """RFC 3986 reference resolution."""
    return pd.Series([None if b is None or u is None else urljoin(b, u) for b, u in zip(base, url, strict=True)])


def status_allowed(status: Column, allowed: list[int] = (), denied: list[int] = ()) -> Column:
    """Denied codes go, allowed ones stay, then 2xx stay and all others go."""
    keep = status.isin(*allowed) | status.between(200, 299) if allowed else status.between(200, 299)
    return F.coalesce(keep & ~status.isin(*denied) if denied else keep, F.lit(False))


def status_category(status: Column) -> Column:
    name = F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))
    return F.when(status.between(200, 599), name).otherwise("other")


def status_flags(status: Column) -> Column:
    """is_success, is_redirect, is_client_error and is_server_error (any code from 500)."""
    return F.struct(
        status.between(200, 299).alias("is_success"), status.between(300, 399).alias("is_redirect"), status.between(400, 499).alias("is_client_error"), (status >= 500).alias("is_server_error")
    )


def retry_decision(status: Column, retries: Column, dont_retry: Column, most: int = 3) -> Column:
    """struct(retry, delay_s, attempt): whether to fetch again, after min(2^(attempt-1), 30) seconds."""
    again = status.isin(*RETRY_CODES) & ~status.isin(*IGNORE_CODES) & ~F.coalesce(dont_retry, F.lit(False)) & (F.coalesce(retries, F.lit(0)) < most)
    again = F.coalesce(again, F.lit(False))
    attempt = F.coalesce(retries, F.lit(0)) + 1
    return F.struct(again.alias("retry"), F.when(again, F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(30.0))).alias("delay_s"), F.when(again, attempt).alias("attempt"))


def task_verdict(error: Column, message: Column) -> Column:
    """retry or ack: network errors and their words are retried, what is gone or broken for good is not, the rest is retried."""
    text = F.lower(F.coalesce(message, F.lit("")))
    network = error.isin("TimeoutError", "ConnectionError", "ConnectionRefusedError", "ConnectionResetError", "OSError", "Timeout", "asyncio.TimeoutError")
    return (
        F.when(network, "retry")
        .when(text.rlike("timeout|connection|reset|refused|timed out"), "retry")
        .when(text.rlike("not found|404|500|internal server"), "ack")
        .otherwise("retry")
    )


def depth_priority(priority: Column, depth: Column, weight: int) -> Column:
    """Stored priority (smaller is sooner) less depth times weight; a missing depth counts 1."""
    return priority - F.coalesce(depth, F.lit(1)) * weight if weight else priority
