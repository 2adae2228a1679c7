"""Urls, times and file places, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDERS = r"^(javascript:|mailto:|tel:|data:)|#$"


def host_of(url: Column) -> Column:
    """The host in lower case, empty if the url has none."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def is_placeholder(href: Column) -> Column:
    """Does a link lead nowhere (empty, #, ...#, or a scheme that is no page)?"""
    trimmed = F.trim(href)
    return (trimmed == "") | F.regexp_like(trimmed, F.lit(PLACEHOLDERS))


def values_of(url: Column, param: str) -> Column:
    """The values of a query parameter, in order; null for what is no absolute url."""
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    found = F.regexp_extract_all(query, F.lit(rf"(?:^|&){re.escape(param)}(?:=([^&]*))?(?=&|$)"), F.lit(1))
    return F.when(F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull(), found)


def has_param(url: Column, param: str) -> Column:
    return F.coalesce(F.size(values_of(url, param)) > 0, F.lit(False))


def page_number(url: Column, param: str = "page") -> Column:
    """The parameter's last value that is a 32-bit unsigned number; null without one."""
    numbers = F.filter(F.transform(values_of(url, param), lambda v: F.when(F.regexp_like(v, F.lit(r"^\+?[0-9]+$")), v.try_cast("long"))), lambda n: n.between(0, 2**32 - 1))
    return F.try_element_at(numbers, F.lit(-1))


def with_page(url: Column, param: str, page: Column) -> Column:
    """The url with every such parameter removed and param=page added at the end; a fragment stays last."""
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    base = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), rf"(?<=[?&]){re.escape(param)}(=[^&]*)?(&|$)", "")
    base = F.regexp_replace(base, "[?&]+$", "")
    pair = F.concat(F.lit(f"{param}="), page.cast("string"))
    sep = F.when(F.contains(base, F.lit("?")), "&").otherwise("?")
    plain = F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), pair)
    return F.when(F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull(), F.concat(base, sep, pair, fragment)).otherwise(plain)


def should_reload(count: Column, threshold: int, has_page_param: Column) -> Column:
    return has_page_param & F.lit(threshold != 0) & (count >= threshold)


def iso8601(seconds: Column) -> Column:
    """Epoch seconds as the store's UTC time, 2024-01-31 12:00:00.000Z. The session's zone must be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss.SSS'Z'")


def capture_place(base: str, url: Column) -> Column:
    """The folder of a page's captures: base/host, or base without a host."""
    return F.concat_ws("/", F.lit(base), F.nullif(host_of(url), F.lit("")))


def now_secs() -> Column:
    """The current time in whole seconds."""
    return F.unix_timestamp()
