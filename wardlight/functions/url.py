"""Parts of URLs as Column expressions, null where a URL doesn't parse.

A URL needs a scheme.  Hosts of web schemes are lower-cased, without user, port or trailing blanks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEB = r"(?i)^\s*(?:https?|ftp|wss?):[/\\]*(?:[^/\\?#@]*@)?(\[[^\]]*\]|[^/\\?#:\s]+)(?::\d*)?(?:[/\\?#].*)?\s*$"


def scheme(url: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return F.when(found != "", found)


def host(url: Column) -> Column:
    """The host, "" for a scheme without one (such as "example.com:8080"), null if it doesn't parse."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), WEB, 1))
    web = scheme(url).isin("http", "https", "ftp", "ws", "wss")
    return F.when(web, F.when(found != "", found)).when(scheme(url).isNotNull(), F.lit(""))


def host_or_guess(url: Column) -> Column:
    """The host as a URL or else behind http://; "" if neither parses."""
    return F.coalesce(host(url), host(F.concat(F.lit("http://"), url)), F.lit(""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host_or_guess(url), "^www\\.", "")


def is_within(host_: Column, domain: Column) -> Column:
    """The host is the domain or below it; false for empty ones."""
    return F.coalesce((host_ != "") & (domain != "") & ((host_ == domain) | F.endswith(host_, F.concat(F.lit("."), domain))), F.lit(False))


def is_official(url: Column, domain: Column) -> Column:
    return is_within(host_or_guess(url), bare_host(domain))


def labels(host_: Column) -> Column:
    return F.filter(F.split(host_, "\\."), lambda p: p != "")


def tld(value: Column) -> Column:
    """The last label of a host or URL that has at least two, else null."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    own = F.when(low.contains("://"), F.coalesce(host(low), low)).otherwise(low)
    parts = labels(F.regexp_replace(F.regexp_replace(own, "\\.$", ""), "^www\\.", ""))
    return F.when(F.size(parts) >= 2, F.element_at(parts, -1))


def resolve(link: Column, base: Column) -> Column:
    """A link made absolute: other schemes stay, //host, /path, ?query, #part and relative paths are joined to the base."""
    link = F.trim(link)
    root = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1)
    page = F.regexp_extract(base, r"(?i)^(https?://[^?#]+)", 1)
    folder = F.when(F.regexp_replace(page, r"(?i)^https?://[^/]+", "").contains("/"), F.regexp_replace(page, "[^/]*$", "")).otherwise(F.concat(root, F.lit("/")))
    slashed = lambda u: F.when(u.rlike(r"(?i)^https?://[^/?#]+$"), F.concat(u, F.lit("/"))).otherwise(u)
    return (
        F.when(scheme(link).isNotNull(), slashed(link))
        .when(root == "", F.lit(None))
        .when(link.startswith("//"), slashed(F.concat(scheme(base), F.lit(":"), link)))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(slashed(page), link))
        .when(link.startswith("#"), F.concat(slashed(F.regexp_extract(base, r"(?i)^(https?://[^#]+)", 1)), link))
        .otherwise(F.concat(folder, F.regexp_replace(link, r"^(?:\./)+", "")))
    )
