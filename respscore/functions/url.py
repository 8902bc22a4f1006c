"""URL parts and request-field predicates (the filter fields a user writes:
host, path, method, status, ext, query, header, body, port, scheme, length,
time, source).

URL parts use the generic-URI regular expression of RFC 3986 appendix B,
which never throws on malformed input (``parse_url`` does) and behaves the
same in every regex engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# --- fixed values: RFC 3986 appendix B and default ports ---------------------
URI_PATTERN = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
HOST_PATTERN = r"^([^@]*@)?(\[[^\]]*\]|[^:]*)(:([0-9]*))?$"
EXT_PATTERN = r"\.([A-Za-z0-9]+)$"
DEFAULT_PORTS = {"http": 80, "https": 443}


def _nullif_empty(c: Column) -> Column:
    return F.when(c == "", F.lit(None)).otherwise(c)


def url_scheme(url: Column | str) -> Column:
    return _nullif_empty(F.lower(F.regexp_extract(_col(url), URI_PATTERN, 2)))


def url_authority(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), URI_PATTERN, 4)


def url_host(url: Column | str) -> Column:
    return _nullif_empty(F.lower(F.regexp_extract(url_authority(url), HOST_PATTERN, 2)))


def url_port(url: Column | str) -> Column:
    """Explicit port, else the scheme's default (80/443), else null."""
    explicit = F.regexp_extract(url_authority(url), HOST_PATTERN, 4)
    scheme = url_scheme(url)
    default = F.when(scheme == "http", F.lit(DEFAULT_PORTS["http"])) \
        .when(scheme == "https", F.lit(DEFAULT_PORTS["https"]))
    return F.when(explicit != "", explicit.cast("int")).otherwise(default)


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), URI_PATTERN, 5)


def url_query(url: Column | str) -> Column:
    u = _col(url)
    return F.when(F.regexp_extract(u, URI_PATTERN, 6) == "", F.lit(None)) \
        .otherwise(F.regexp_extract(u, URI_PATTERN, 7))


def path_ext(path: Column | str) -> Column:
    """Extension of the last path segment ('' when none)."""
    return F.lower(F.regexp_extract(_col(path), EXT_PATTERN, 1))


def with_url_parts(df, url: str = "url"):
    """Add scheme, host, port, path, query and ext columns for filtering."""
    return df.select("*",
                     url_scheme(url).alias("scheme"), url_host(url).alias("host"),
                     url_port(url).alias("port"), url_path(url).alias("path"),
                     url_query(url).alias("query"), path_ext(url_path(url)).alias("ext"))


def header_contains(headers: Column | str, needle: str) -> Column:
    """Any header line "name: value" contains ``needle`` (headers as MAP<STRING, ARRAY<STRING>>)."""
    entries = F.map_entries(_col(headers))
    return F.exists(entries, lambda e: F.exists(
        e["value"], lambda v: F.concat_ws(": ", e["key"], v).contains(needle)))


def body_contains(body: Column | str, needle: str) -> Column:
    return F.coalesce(_col(body).contains(needle), F.lit(False))
