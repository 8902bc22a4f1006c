"""Result view operators: colour category, high-rank flag, user sort, row
slices and target choice (selected rows, else all)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (COLOR_CLIENT_ERROR, COLOR_HTML, COLOR_JSON, COLOR_NONE,
                                   COLOR_REDIRECT, COLOR_SERVER_ERROR, COLOR_XML,
                                   HIGH_RANK_THRESHOLD, HTML_MARKERS, JSON_MARKERS,
                                   XML_EXCLUDE, XML_MARKERS)
from ..functions.text import _col
from ..session import materialize
from .joins import key_join
from .select import FEW

CATEGORY_COLORS = {
    "red": COLOR_SERVER_ERROR, "amber": COLOR_CLIENT_ERROR, "olive": COLOR_REDIRECT,
    "green": COLOR_JSON, "blue": COLOR_XML, "cyan": COLOR_HTML, "none": COLOR_NONE,
}


def _any_contains(c: Column, markers: Sequence[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | c.contains(m)
    return out


def row_category(status: Column | str, content_type: Column | str) -> Column:
    """Colour category of a result row; substring tests in rule order."""
    s = _col(status)
    ct = F.lower(F.coalesce(_col(content_type), F.lit("")))
    return (F.when(s >= 500, "red").when(s >= 400, "amber").when(s >= 300, "olive")
            .when((s >= 200) & _any_contains(ct, JSON_MARKERS), "green")
            .when((s >= 200) & _any_contains(ct, XML_MARKERS) & ~ct.contains(XML_EXCLUDE), "blue")
            .when((s >= 200) & _any_contains(ct, HTML_MARKERS), "cyan")
            .otherwise("none"))


def category_color(category: Column | str) -> Column:
    c = _col(category)
    out = F.lit(COLOR_NONE)
    for name, hexv in CATEGORY_COLORS.items():
        out = F.when(c == name, hexv).otherwise(out)
    return out


def is_high(rank: Column | str = "rank") -> Column:
    return _col(rank) > HIGH_RANK_THRESHOLD


def annotate(results: DataFrame) -> DataFrame:
    """Add category, color and is_high to rank results (narrow projection)."""
    cat = row_category("status_code", "content_type")
    return results.select("*", cat.alias("category"), category_color(cat).alias("color"),
                          is_high().alias("is_high"))


STRING_FIELDS = ("method", "url", "content_type", "location")


def user_sort(results: DataFrame, field: str | None, direction: str = "none",
              order: Sequence[Column] = ()) -> DataFrame:
    """Sort by one result column: ``asc``, ``desc`` or ``none`` (rank order).

    Strings compare with the root Unicode collation (locale-aware, so
    "a" < "A" < "b"); a missing location sorts last.  Ties keep the rank
    order given by ``order`` (the sort is stable over the ranked list)."""
    if direction not in ("asc", "desc", "none"):
        raise ValueError("direction must be asc, desc or none")
    base = list(order) or [F.col("rank").desc()]
    if direction == "none" or not field:
        return results.orderBy(*base)
    key = F.col(field)
    if field in STRING_FIELDS:
        key = F.collate(key, "UNICODE")
    key = key.asc_nulls_last() if direction == "asc" else key.desc_nulls_last()
    return results.orderBy(key, *base)


def row_slice(sorted_results: DataFrame, start: int, end: int) -> DataFrame:
    """Rows [start, end) of an already totally ordered result, in order.  Near the top the first ``end`` rows
    of each task are merged in one; any other page is cut by ``deep_slice``."""
    start, end = max(0, int(start)), int(end)
    if end <= FEW:
        return sorted_results.offset(start).limit(max(0, end - start))
    return deep_slice(sorted_results, start, end)


def deep_slice(sorted_results: DataFrame, start: int, end: int, materialize_how: str = "auto") -> DataFrame:
    """Rows [start, end) anywhere in an ordered result, without a limit in the plan: the result is kept once
    in its range partitions, each row numbered within its own; the partitions' sizes, summed up, turn
    the slice into one range of these numbers, which reaches the scan of the kept table."""
    placed = materialize(sorted_results.withColumn("_at", F.monotonically_increasing_id()), materialize_how)
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per partition
    before, low, high = 0, None, None
    for r in sorted(sizes, key=lambda r: r["p"]):
        first, last = max(start, before), min(end, before + r["n"])
        if first < last:
            low = (r["p"] << 33) + first - before if low is None else low
            high = (r["p"] << 33) + last - before
        before += r["n"]
    inside = (F.col("_at") >= low) & (F.col("_at") < high) if low is not None else F.lit(False)
    return placed.where(inside).orderBy("_at").drop("_at")


def targets(results: DataFrame, selection: DataFrame | None = None, on: str = "id") -> DataFrame:
    """Selected result rows when a selection is given, else all results.  The join may lose the order
    of ``results``; sort what is shown or written."""
    if selection is None:
        return results
    return key_join(results, selection.select(on).distinct(), on, "left_semi")
