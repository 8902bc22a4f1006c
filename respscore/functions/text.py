"""Column functions for response fields (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType

from .constants import JS_TRIM_CLASS, TOKEN_PATTERN, UNKNOWN_TYPE


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_length(body: Column | str) -> Column:
    """Body size in bytes, 0 when there is no body (works for STRING and BINARY)."""
    return F.coalesce(F.octet_length(_col(body)), F.lit(0)).cast("bigint")


def status_or_zero(code: Column | str) -> Column:
    """Status code with 0 for a missing code."""
    return F.coalesce(_col(code).cast("int"), F.lit(0))


def first_header(headers: Column | str, name: str) -> Column:
    """First value of a header from a MAP<STRING, ARRAY<STRING>>; names match in any case (of several
    spellings of one name, the first in the map counts)."""
    named = F.filter(F.map_entries(_col(headers)), lambda e: F.lower(e["key"]) == name.lower())
    return F.try_element_at(F.try_element_at(named, F.lit(1))["value"], F.lit(1))


def js_trim(c: Column | str) -> Column:
    """Trim with ECMAScript white-space rules (Spark's trim only strips spaces)."""
    return F.regexp_replace(_col(c), f"^{JS_TRIM_CLASS}+|{JS_TRIM_CLASS}+$", "")


def mime_type(header: Column | str) -> Column:
    """Normalised MIME type: text before the first ';', trimmed, lower-cased;
    'unknown' when the header is missing or empty.  A header such as '; x'
    gives the empty string, not 'unknown'."""
    h = _col(header)
    return (
        F.when(F.coalesce(h, F.lit("")) == "", F.lit(UNKNOWN_TYPE))
        .otherwise(F.lower(js_trim(F.split_part(h, F.lit(";"), F.lit(1)))))
    )


def body_text(body: Column | str, dtype: DataType | None = None,
              max_chars: int | None = None) -> Column:
    """Body as text; BINARY bodies are decoded as UTF-8 with bad bytes replaced.

    With ``max_chars``, a BINARY body is cut to 4 * max_chars bytes before
    decoding: a character takes at most 4 bytes and an invalid byte becomes
    one replacement character, so the first max_chars characters are intact
    while the work per row stays bounded."""
    b = _col(body)
    if isinstance(dtype, BinaryType):
        if max_chars is not None:
            b = F.substring(b, 1, 4 * max_chars)
        return F.make_valid_utf8(b.cast("string"))
    return b


def js_slice(text: Column | str, units: int | None = None) -> Column:
    """First ``units`` UTF-16 code units of the text, as JavaScript's
    ``String.prototype.slice(0, units)`` counts them.

    Texts of at most units/2 bytes (so at most units/2 characters) cannot
    exceed the limit and pass through untouched - an O(1) test, no scan;
    the others are cut on their UTF-16LE encoding,
    backing off one unit when the cut would split a surrogate pair (the
    dropped half is not a word character, so tokens are unchanged).  Every
    character is at least one unit, so only the first ``units`` characters
    are encoded: per-row work is bounded whatever the body size.
    ``units=None`` keeps the whole text."""
    t = _col(text)
    if units is None:
        return t
    nbytes = 2 * units
    enc = F.encode(F.substring(t, 1, units), "UTF-16LE")
    high_byte = F.hex(F.substring(enc, nbytes, 1))
    cut = F.when(high_byte.between("D8", "DB"), F.lit(nbytes - 2)).otherwise(F.lit(nbytes))
    truncated = F.decode(F.substring(enc, F.lit(1), cut), "UTF-16LE")
    return F.when(F.octet_length(t) <= units // 2, t).otherwise(truncated)


def tokens(text: Column | str) -> Column:
    """Word tokens: maximal runs of [a-z0-9] in the lower-cased text."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_PATTERN), F.lit(0))


def fingerprint_hex(fp: Column | str) -> Column:
    """A 64-bit fingerprint held in BIGINT as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(_col(fp)), 16, "0"))
