"""Order statistics over whole tables: the first k rows of an order, for any k.

A small k is a top-k merge.  A large one would merge k rows of every task in
one, so there the k-th key is found first: rows are counted by equal ranges of
their order code (a hash aggregate of at most ``BINS`` groups), the range that
holds the k-th row is narrowed to the smallest and largest code in it, and so
on until few rows or one code are left.  The result is then a filter on that
key.  Nothing but the counts of ranges reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import order_code, sort_exprs

FEW = 10_000  # rows that one task may merge
BINS = 1024   # ranges counted at once


@dataclass(frozen=True)
class Cut:
    """The k-th smallest code, how many rows lie below it and how many have it."""
    code: Decimal
    below: int
    equal: int


def _literal(value: Decimal) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def kth_code(rows: DataFrame, code: str, k: int, few: int = FEW, bins: int = BINS) -> Cut | None:
    """The k-th smallest value (from 1) of a DECIMAL(38,0) column without nulls; None if there are fewer rows.

    Each round splits the range between its smallest and largest code, which fall into different
    bins, so it ends; bins are ordered as codes are, so rounding cannot mix them up."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.min(code).alias("lo"), F.max(code).alias("hi")).first()
    n, lo, hi, below = r["n"], r["lo"], r["hi"], 0
    if n < k:
        return None
    while lo != hi:
        inside = rows.where(F.col(code).between(_literal(lo), _literal(hi)))
        if n <= few:
            last = inside.groupBy(code).agg(F.count(F.lit(1)).alias("n")).orderBy(code).limit(few).collect()
            for r in last:
                if below + r["n"] >= k:
                    return Cut(r[code], below, r["n"])
                below += r["n"]
        width = float(hi - lo) / bins
        at = F.least(F.floor((F.col(code) - _literal(lo)).cast("double") / F.lit(width)), F.lit(bins - 1))
        found = inside.groupBy(at.alias("_bin")).agg(F.count(F.lit(1)).alias("n"), F.min(code).alias("lo"), F.max(code).alias("hi")).collect()
        for r in sorted(found, key=lambda r: r["_bin"]):
            if below + r["n"] >= k:
                n, lo, hi = r["n"], r["lo"], r["hi"]
                break
            below += r["n"]
    return Cut(lo, below, n)


def first_rows(rows: DataFrame, order: Sequence[str], descending: bool, k: int, few: int = FEW) -> DataFrame:
    """The first ``k`` rows in the order of some columns, unordered.

    Keys that do not pack into one code (a STRING behind the leading one) are cut at the leading
    key, and only rows that tie there are ordered by the rest.  Rows equal in every key are
    interchangeable: as many as are needed are taken."""
    order = list(order)
    if k <= few:
        return rows.orderBy(*sort_exprs(order, descending)).limit(k)
    code, used = order_code(rows, order, descending), order
    if code is None:
        code, used = order_code(rows, order[:1], descending), order[:1]
    if code is None:  # no leading key of a bounded width
        return rows.orderBy(*sort_exprs(order, descending)).limit(k)
    cut = kth_code(rows.select(*used).select(code.alias("_code")), "_code", k, few)
    if cut is None:
        return rows
    if cut.below + cut.equal == k:
        return rows.where(code <= _literal(cut.code))
    ties = rows.where(code == _literal(cut.code))
    rest = order[len(used):]
    some = ties.orderBy(*sort_exprs(rest, descending)).limit(k - cut.below) if rest else ties.limit(k - cut.below)
    return rows.where(code < _literal(cut.code)).unionByName(some)
