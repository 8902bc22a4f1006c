"""Mergeable profile of a growing history: what a run over grown traffic needs of the old one.

A state is two narrow tables: ``pairs`` (counts and exact length sums by status
and MIME type) and ``prints`` (by fingerprint: its count and the input position
of its last occurrence).  Counts and sums add up and positions take the
maximum, so states merge in any order and grouping, and the statistics of old
and new records together come from the old state and the new records alone.
Removing records is not possible: a maximum cannot be undone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import order_code
from ..functions.text import fingerprint_hex
from .profile import Stats, frequencies_of, moments_of, sigma, summary

PAIRS = "status_code int, content_type string, cnt bigint, sum_length decimal(38,0), sum_length_sq decimal(38,0)"
PRINTS = "fingerprint bigint, fp_count bigint, last_pos decimal(38,0)"


@dataclass(frozen=True)
class ProfileState:
    pairs: DataFrame
    prints: DataFrame


def _pairs(rows: DataFrame) -> DataFrame:
    wide = lambda c: F.sum(c).cast("decimal(38,0)").alias(c)
    return rows.groupBy("status_code", "content_type").agg(F.sum("cnt").cast("bigint").alias("cnt"), wide("sum_length"), wide("sum_length_sq"))


def _prints(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fingerprint").agg(F.sum("fp_count").cast("bigint").alias("fp_count"), F.max("last_pos").alias("last_pos"))


def profile_state(feats: DataFrame, order: Sequence[str] = ("created_at", "id"), descending: bool = True) -> ProfileState:
    """The state of some feature rows.  The order keys must pack into one code, which means the same
    in every part of the history."""
    code = order_code(feats, list(order), descending)
    if code is None:
        raise ValueError("order columns must pack into one code: a time or number, then whole numbers")
    prints = feats.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("fp_count"), F.max(code).alias("last_pos"))
    return ProfileState(_pairs(summary(feats)), prints.select("fingerprint", "fp_count", F.col("last_pos").cast("decimal(38,0)").alias("last_pos")))


def merge_states(*states: ProfileState) -> ProfileState:
    """The state of all records of several states together; the order of the states has no meaning."""
    both = lambda side: reduce(DataFrame.unionByName, [getattr(s, side) for s in states])
    return ProfileState(_pairs(both("pairs")), _prints(both("prints")))


def empty_state(spark: SparkSession) -> ProfileState:
    return ProfileState(spark.createDataFrame([], PAIRS), spark.createDataFrame([], PRINTS))


def save_state(state: ProfileState, path: str) -> None:
    """Write a state as two tables under a new folder; a state that was read from there stays readable."""
    state.pairs.write.parquet(f"{path}/pairs")
    state.prints.write.parquet(f"{path}/prints")


def load_state(spark: SparkSession, path: str) -> ProfileState:
    return ProfileState(spark.read.schema(PAIRS).parquet(f"{path}/pairs"), spark.read.schema(PRINTS).parquet(f"{path}/prints"))


def _mode(state: ProfileState) -> DataFrame:
    """The most frequent fingerprint; of equal ones that whose last occurrence comes first."""
    return state.prints.orderBy(F.col("fp_count").desc(), F.col("last_pos").asc()).limit(1)


def state_stats(state: ProfileState) -> Stats:
    """The scalars that scoring needs (``operators.profile.collect_stats`` over all records)."""
    m = moments_of(state.pairs).first()
    if not m["n"]:
        return Stats(0, 0, 0, 0)
    return Stats(int(m["n"]), int(m["sum_length"]), int(m["sum_length_sq"]), int(_mode(state).first()["fingerprint"]))


def state_profile(state: ProfileState) -> DataFrame:
    """One row n, mean_length, sd_length, centroid: the profile of all records of a state."""
    m = moments_of(state.pairs).where("n > 0")
    centroid = _mode(state).select("fingerprint").scalar()
    return m.select("n", (F.col("sum_length").cast("double") / F.col("n")).alias("mean_length"),
                    sigma("n", "sum_length", "sum_length_sq").alias("sd_length"), fingerprint_hex(centroid).alias("centroid"))


def score_grown(new: DataFrame, state: ProfileState, order: Sequence[str] = ("created_at", "id")) -> tuple[DataFrame, ProfileState]:
    """Score the feature rows ``new`` against all records so far and themselves: the ranks that a run over
    everything gives them, and the grown state.  Only ``new`` is read beside the state."""
    from .joins import key_join
    from .score import RESULT_COLUMNS, score_columns

    grown = merge_states(state, profile_state(new, order))
    stats = state_stats(grown)
    scores = score_columns(stats)
    both = key_join(new, frequencies_of(grown.pairs), ["status_code", "content_type"])
    extra = [c for c in order if c not in RESULT_COLUMNS]
    return both.select(*[scores["rank"].alias("rank") if c == "rank" else F.col(c) for c in RESULT_COLUMNS], *extra), grown
