"""Grouped rank: the reference's statistics computed per group key (e.g. per
host), so one job ranks every group instead of one run per selection.

Group keys are renamed in the feature table, so any column may group, a
result column too.  Every statistic is a map-side-combined aggregate, and the
per-group mode avoids windows: a group holding a third of all rows never
lands in one task.

    summary: (group, status, type) counts and exact length sums -- one pass
    (group, fp) counts + last position   -- hash aggregate, materialised once
    per group: moments, centroid; per pair: both frequencies -- from those tables
    one join of the features on (group, status, type), which AQE may split
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import HASH_BITS, LENGTH_SIGMAS
from ..functions.order import order_code, order_struct, sort_exprs
from ..functions.simhash import hamming
from ..functions.text import fingerprint_hex
from ..session import materialize
from .features import response_features
from .joins import key_join
from .profile import frequencies_of, sigma
from .score import RESULT_COLUMNS

_D = "decimal(38,0)"


def group_summary(feats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and exact length sums by (by..., status_code, content_type)."""
    ln = F.col("content_length").cast(_D)
    return feats.groupBy(*by, "status_code", "content_type").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(ln).alias("_s1"), F.sum(ln * ln).alias("_s2"))


def group_moments(summ: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: n, mean_length, sd_length."""
    sums = summ.groupBy(*by).agg(F.sum("cnt").alias("n"), F.sum("_s1").alias("_s1"), F.sum("_s2").alias("_s2"))
    return sums.select(*by, "n", (F.col("_s1").cast("double") / F.col("n").cast("double")).alias("mean_length"),
                       sigma("n", "_s1", "_s2").alias("sd_length"))


def group_mode_centroid(feats: DataFrame, by: Sequence[str], order: Sequence[str],
                        descending: bool, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Per group: the most frequent fingerprint, ties to the first to reach
    the top count (earliest last occurrence in input order).  ``keep``
    materialises the table of (group, fingerprint) counts, read several times."""
    by, order = list(by), list(order)
    code = order_code(feats, order, descending)
    if code is not None:
        return _group_mode(feats, by, F.max(code), F.min_by, keep)
    lead = order_code(feats, order[:1], descending) if len(order) > 1 else None
    if lead is None:
        return _group_mode_struct(feats, by, order, descending, keep)
    return _group_mode_lead(feats, by, order, descending, lead, keep)


def _group_mode(feats: DataFrame, by: list[str], last: Column, pick, keep=lambda df: df) -> DataFrame:
    fq = keep(feats.groupBy(*by, "fingerprint").agg(F.count(F.lit(1)).alias("_c"), last.alias("_last")))
    top = fq.groupBy(*by).agg(F.max("_c").alias("_top"))
    cand = key_join(fq, top, by).where(F.col("_c") == F.col("_top"))
    return cand.groupBy(*by).agg(pick("fingerprint", "_last").alias("centroid"))


def _group_mode_struct(feats: DataFrame, by: list[str], order: list[str],
                       descending: bool, keep=lambda df: df) -> DataFrame:
    """Order keys that do not pack at all: struct positions (sort aggregate)."""
    if descending:
        return _group_mode(feats, by, F.min(order_struct(order)), F.max_by, keep)
    return _group_mode(feats, by, F.max(order_struct(order)), F.min_by, keep)


def _group_mode_lead(feats: DataFrame, by: list[str], order: list[str], descending: bool,
                     lead: Column, keep=lambda df: df) -> DataFrame:
    """Leading key packed (e.g. created_at before a STRING id): hash
    aggregates choose per group by (count, last leading position); only
    groups whose best candidates tie exactly compare the remaining keys,
    over just those candidates' rows at that position."""
    fq = keep(feats.groupBy(*by, "fingerprint").agg(F.count(F.lit(1)).alias("_c"), F.max(lead).alias("_l")))
    top = fq.groupBy(*by).agg(F.max("_c").alias("_top"))
    c1 = key_join(fq, top, by).where(F.col("_c") == F.col("_top"))
    first = c1.groupBy(*by).agg(F.min("_l").alias("_lmin"))
    c2 = key_join(c1, first, by).where(F.col("_l") == F.col("_lmin"))
    counts = c2.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"), F.max("fingerprint").alias("_fp"))
    single = counts.where(F.col("_k") == 1).select(*by, F.col("_fp").alias("centroid"))
    tied = key_join(c2, counts.where(F.col("_k") > 1).select(*by), by, "left_semi")
    rows = key_join(feats.withColumn("_lead", lead),
                    tied.select(*by, "fingerprint", F.col("_l").alias("_lead")),
                    [*by, "fingerprint", "_lead"], "left_semi")
    rest = order_struct(order[1:])
    per_fp = rows.groupBy(*by, "fingerprint").agg((F.min(rest) if descending else F.max(rest)).alias("_r"))
    pick = F.max_by if descending else F.min_by
    resolved = per_fp.groupBy(*by).agg(pick("fingerprint", "_r").alias("centroid"))
    return single.unionByName(resolved)


def group_majority_centroid(feats: DataFrame, by: Sequence[str]) -> DataFrame:
    bit = lambda i: F.shiftrightunsigned("fingerprint", i).bitwiseAND(F.lit(1))
    ones = feats.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"),
                                  *[F.sum(bit(i)).alias(f"_o{i}") for i in range(HASH_BITS)])
    fp = F.lit(0).cast("bigint")
    for i in range(HASH_BITS):
        fp = fp.bitwiseOR(F.when(2 * F.col(f"_o{i}") > F.col("_n"),
                                 F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0)))
    return ones.select(*by, fp.alias("centroid"))


def group_score_columns() -> dict[str, Column]:
    """Same operations, in the same order, as the single-group scoring."""
    n = F.col("n")
    lo = F.least(F.abs(F.col("content_length") - F.col("mean_length"))
                 / (F.col("sd_length") * F.lit(LENGTH_SIGMAS)), F.lit(1.0))
    sr = F.lit(1) - F.col("status_count") / n
    tr = F.lit(1) - F.col("type_count") / n
    hd = hamming("fingerprint", "centroid")
    stat = (lo + sr + tr) / F.lit(3.0)
    rank = F.round((stat * F.lit(0.5) + hd / F.lit(float(HASH_BITS)) * F.lit(0.5)) * F.lit(100.0), 0)
    return {"length_outlier": lo, "status_rarity": sr, "type_rarity": tr, "hamming": hd,
            "rank": rank.cast("int")}


def rank_by(history: DataFrame, by: Sequence[str], order: Sequence[str] = ("created_at", "id"),
            descending: bool = True, centroid: str = "mode",
            max_body_units: int | None = None, fingerprint: str = "udf",
            details: bool = False, sort: bool = True, top: int | None = None,
            materialize_how: str = "auto") -> DataFrame:
    """Rank every record with a response against the statistics of its own
    group (``by`` columns of ``history``; a result column groups by its
    normalised value).  Output: the ``by`` columns, the result columns and any
    extra order columns; sorted by group, then rank order within the group.
    ``top`` keeps the first k rows of the rank order over all groups."""
    by, order = list(by), list(order)
    if not by:
        raise ValueError("rank_by needs group columns; use rank() for one group")
    keep = lambda df: materialize(df, materialize_how)
    keys = [f"_g{i}" for i in range(len(by))]
    feats = response_features(history, order, max_body_units, fingerprint, carry=by)
    feats = keep(feats.select("*", *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]))
    if centroid == "mode":
        cen = group_mode_centroid(feats, keys, order, descending, keep)
    elif centroid == "majority":
        cen = group_majority_centroid(feats, keys)
    else:
        raise ValueError(f"unknown centroid rule: {centroid!r}")
    summ = keep(group_summary(feats, keys))
    groups = key_join(group_moments(summ, keys), cen, keys)
    lookup = keep(key_join(frequencies_of(summ, keys), groups, keys))
    j = key_join(feats, lookup, [*keys, "status_code", "content_type"])
    sc = group_score_columns()
    extra = [c for c in order if c not in RESULT_COLUMNS and c not in by]
    cols = [F.col(k).alias(c) for c, k in zip(by, keys, strict=True)]
    cols += [sc["rank"].alias("rank") if c == "rank" else F.col(c) for c in RESULT_COLUMNS if c not in by]
    cols += [F.col(c) for c in extra]
    if details:
        cols += [fingerprint_hex("fingerprint").alias("fingerprint"),
                 sc["hamming"].alias("hamming"), sc["length_outlier"].alias("length_outlier"),
                 sc["status_rarity"].alias("status_rarity"), sc["type_rarity"].alias("type_rarity")]
    out = j.select(*cols)
    if top is not None:
        return out.orderBy(F.col("rank").desc(), *sort_exprs(order, descending)).limit(int(top))
    if not sort:
        return out
    return out.orderBy(*[F.col(c).asc_nulls_first() for c in by], F.col("rank").desc(),
                       *sort_exprs(order, descending))
