"""The anomaly rank: statistical rarity + structural distance, 0-100.

Plan shape (see ``rank_responses``):

1. features  - one scan of history, F2 filter, fingerprint; materialised
               once (a Parquet table in the shared checkpoint folder when
               one is set, else MEMORY_AND_DISK) because several passes
               read it, the statistics passes only a few of its columns.
2. summary   - ONE map-side-combined aggregate by (status, MIME type) with
               exact length sums; moments and both frequencies are rolled
               up from it.
3. centroid  - fingerprint frequencies (map-side combined) and a top-1.
4. scalars   - n, moments and centroid become literals, so the scoring
               projection needs no join for them.
5. score     - one join on (status, MIME type) for both frequencies, one
               projection; then a global range sort, or top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import HASH_BITS, LENGTH_SIGMAS
from ..functions.order import sort_exprs
from ..functions.simhash import hamming
from ..functions.text import fingerprint_hex
from ..session import materialize
from .features import response_features
from .joins import key_join
from .profile import Stats, collect_stats, frequencies_of, summary
from .select import FEW, first_rows

RESULT_COLUMNS = ["id", "rank", "method", "url", "status_code", "content_length",
                  "content_type", "location"]


def score_columns(stats: Stats) -> dict[str, Column]:
    """Component scores, in the reference's order of floating-point operations."""
    n = F.lit(stats.n if stats.n else 1).cast("bigint")
    lo = F.least(F.abs(F.col("content_length") - F.lit(stats.mean)) / F.lit(stats.sd * LENGTH_SIGMAS),
                 F.lit(1.0))
    sr = F.lit(1) - F.col("status_count") / n
    tr = F.lit(1) - F.col("type_count") / n
    hd = hamming("fingerprint", F.lit(stats.centroid).cast("bigint"))
    stat = (lo + sr + tr) / F.lit(3.0)
    sim = hd / F.lit(float(HASH_BITS))
    rank = F.round((stat * F.lit(0.5) + sim * F.lit(0.5)) * F.lit(100.0), 0).cast("int")
    return {"length_outlier": lo, "status_rarity": sr, "type_rarity": tr,
            "hamming": hd, "rank": rank}


def score_features(feats: DataFrame, stats: Stats, order: Sequence[str],
                   details: bool = False, summ: DataFrame | None = None) -> DataFrame:
    """Attach frequencies and score every feature row (no ordering); ``summ``
    is the features' summary (default: computed here)."""
    with_freq = key_join(feats, frequencies_of(summ if summ is not None else summary(feats)), ["status_code", "content_type"])
    sc = score_columns(stats)
    extra = [c for c in order if c not in RESULT_COLUMNS]
    cols = [sc["rank"].alias("rank") if c == "rank" else F.col(c) for c in RESULT_COLUMNS]
    cols += [F.col(c) for c in extra]
    if details:
        cols += [fingerprint_hex("fingerprint").alias("fingerprint"),
                 sc["hamming"].alias("hamming"),
                 sc["length_outlier"].alias("length_outlier"),
                 sc["status_rarity"].alias("status_rarity"),
                 sc["type_rarity"].alias("type_rarity")]
    return with_freq.select(*cols)


def rank_order(order: Sequence[str], descending: bool) -> list[Column]:
    """Rank descending; ties keep input order (the reference sort is stable)."""
    return [F.col("rank").desc(), *sort_exprs(order, descending)]


def top_rows(scored: DataFrame, order: Sequence[str], descending: bool, top: int, few: int = FEW) -> DataFrame:
    """The first ``top`` rows of the rank order, in that order.

    A small ``top`` is a merge of the tasks' first rows.  A large one is a filter: the ranks are counted
    (they have 101 values), everything above the rank at the cut is in, and of the rows that tie there
    the first in input order, found as ``first_rows`` does."""
    if top <= few:
        return scored.orderBy(*rank_order(order, descending)).limit(top)
    left, cut, ties = top, None, 0
    for r in sorted(scored.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["rank"]):
        if r["n"] > left:
            cut, ties = r["rank"], left
            break
        left -= r["n"]
    kept = scored
    if cut is not None:
        kept = scored.where(F.col("rank") > cut)
        if ties:
            kept = kept.unionByName(first_rows(scored.where(F.col("rank") == cut), order, descending, ties, few))
    return kept.orderBy(*rank_order(order, descending))


def rank_responses(history: DataFrame, order: Sequence[str] = ("created_at", "id"),
                   descending: bool = True, centroid: str = "mode",
                   max_body_units: int | None = None, fingerprint: str = "udf",
                   details: bool = False, sort: bool = True, top: int | None = None,
                   materialize_how: str = "auto") -> DataFrame:
    """Rank every record of ``history`` that has a response.

    ``order``/``descending`` give the input order (ties in rank keep it, and
    the mode centroid's tie rule walks it).  A history scan is
    ``("created_at", "id")`` descending (newest first); an id list is its
    position column ascending.  ``centroid`` is ``mode`` (most frequent
    fingerprint, reference behaviour) or ``majority`` (bitwise majority).
    ``top`` keeps the first k rows of the rank order, any k (``top_rows``)."""
    order = list(order)
    feats = response_features(history, order, max_body_units, fingerprint)
    return rank_features(feats, order, descending, centroid, details, sort, top, materialize_how)


def rank_features(feats: DataFrame, order: Sequence[str], descending: bool = True,
                  centroid: str = "mode", details: bool = False, sort: bool = True,
                  top: int | None = None, materialize_how: str = "auto") -> DataFrame:
    """``rank_responses`` from already built feature rows (see ``response_features``)."""
    order = list(order)
    feats = materialize(feats, materialize_how)
    summ = materialize(summary(feats), materialize_how)
    stats = collect_stats(feats, order, descending, centroid, summ)
    scored = score_features(feats, stats, order, details, summ)
    if top is not None:
        return top_rows(scored, order, descending, int(top))
    return scored.orderBy(*rank_order(order, descending)) if sort else scored
