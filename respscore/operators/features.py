"""Per-response feature rows: the narrow table every statistic is built from.

``measure_bodies`` turns bodies into their length and fingerprint where they
lie; ``response_features`` drops records without a response (before any
statistic) and normalises the fields.  A history that is measured before its
tables are joined never moves a body.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.simhash import simhash64, simhash_frame
from ..functions.text import (body_text, content_length, first_header, js_slice, mime_type,
                              status_or_zero)


FEATURE_FIELDS = ("method", "url", "location", "status_code", "content_length", "content_type",
                  "fingerprint")


def _field(df: DataFrame, name: str, header: str | None = None) -> Column:
    cols = set(df.columns)
    if name in cols:
        return F.col(name)
    if header and "headers" in cols:
        return first_header("headers", header)
    return F.lit(None).cast("string")


def measure_bodies(df: DataFrame, body: str = "body", max_body_units: int | None = None,
                   fingerprint: str = "udf") -> DataFrame:
    """``df`` with its body column replaced by ``content_length`` and
    ``fingerprint`` (BIGINT bit pattern) of the whole body.

    ``max_body_units`` fingerprints only that many UTF-16 units from the
    start (``PREFIX_BODY_UNITS`` is the interactive tool's cut); the length is
    always that of the whole body.  ``fingerprint`` is ``udf`` (Arrow UDF) or
    ``frame`` (pure DataFrame plan)."""
    if fingerprint not in ("udf", "frame"):
        raise ValueError(f"unknown fingerprint implementation: {fingerprint!r}")
    kind = df.schema[body].dataType
    text = js_slice(body_text(F.col(body), kind, max_body_units), max_body_units)
    rest = [c for c in df.columns if c != body]
    base = df.select(*rest, content_length(body).alias("content_length"), text.alias("_text"))
    if fingerprint == "frame":
        return simhash_frame(base, "_text")
    return base.withColumn("fingerprint", simhash64("_text")).drop("_text")


def response_features(history: DataFrame, order: Sequence[str] = ("created_at", "id"),
                      max_body_units: int | None = None,
                      fingerprint: str = "udf", carry: Sequence[str] = ()) -> DataFrame:
    """Feature rows for the records of ``history`` that have a response.

    Columns: id, the ``order`` columns, method, url, location, status_code,
    content_length, content_type, fingerprint (BIGINT bit pattern).

    ``history`` uses the canonical schema (id, created_at, method, url,
    has_response, status_code, content_type_header, location, body) or the
    wide form with ``headers MAP<STRING, ARRAY<STRING>>`` (names in any
    case), and holds either ``body`` or what ``measure_bodies`` made of it.
    ``carry`` names extra history columns to keep (e.g. a group key)."""
    if fingerprint not in ("udf", "frame"):
        raise ValueError(f"unknown fingerprint implementation: {fingerprint!r}")
    h = history
    if "has_response" in h.columns:
        h = h.where(F.col("has_response"))
    measured = {"content_length", "fingerprint"} <= set(h.columns)
    if "body" not in h.columns and not measured:
        h = h.withColumn("body", F.lit(None).cast("string"))
    # a carried column that is also a feature field is served by the feature
    keys = list(dict.fromkeys(["id", *order, *[c for c in carry if c not in FEATURE_FIELDS]]))
    base = h.select(
        *[F.col(c) for c in keys],
        F.coalesce(_field(h, "method"), F.lit("")).alias("method"),
        F.coalesce(_field(h, "url"), F.lit("")).alias("url"),
        _field(h, "location", "location").alias("location"),
        status_or_zero(_field(h, "status_code")).alias("status_code"),
        mime_type(_field(h, "content_type_header", "content-type")).alias("content_type"),
        *(["content_length", "fingerprint"] if measured else [F.col("body").alias("_body")]),
    )
    out = base if measured else measure_bodies(base, "_body", max_body_units, fingerprint)
    return out.select(*keys, *FEATURE_FIELDS)
