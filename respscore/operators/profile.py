"""Dataset statistics over feature rows (count, length moments, frequencies,
centroid fingerprint).

Every statistic is a map-side-combined aggregate: a key that holds a third
of all rows (one status, one MIME type, one fingerprint) is reduced inside
each task before the shuffle, so no task ever sees a hot group whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import HASH_BITS
from ..functions.order import order_code, order_struct
from ..functions.text import fingerprint_hex
from .joins import key_join

_D = "decimal(38,0)"


def length_moments(feats: DataFrame) -> DataFrame:
    """One row: n, sum_length, sum_length_sq, all exact (DECIMAL), so mean and
    sigma do not depend on task order (double sums would drift)."""
    ln = F.col("content_length").cast(_D)
    return feats.agg(F.count(F.lit(1)).alias("n"),
                     F.sum(ln).alias("sum_length"),
                     F.sum(ln * ln).alias("sum_length_sq"))


def summary(feats: DataFrame) -> DataFrame:
    """Counts and exact length sums by (status_code, content_type): ``cnt, sum_length, sum_length_sq``.
    Map-side combined, so the shuffle carries one row per (task, pair); every other count and moment
    is rolled up from these few rows."""
    ln = F.col("content_length").cast(_D)
    return feats.groupBy("status_code", "content_type").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(ln).alias("sum_length"), F.sum(ln * ln).alias("sum_length_sq"))


def moments_of(summ: DataFrame) -> DataFrame:
    """One row (n, sum_length, sum_length_sq) from a summary."""
    return summ.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"), F.sum("sum_length").alias("sum_length"),
                    F.sum("sum_length_sq").alias("sum_length_sq"))


def frequencies_of(summ: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The pairs of a summary (within groups ``by``) with ``status_count`` and ``type_count``: the table
    that a feature row needs for its rarities, joined once."""
    by = list(by)
    status = summ.groupBy(*by, "status_code").agg(F.sum("cnt").alias("status_count"))
    types = summ.groupBy(*by, "content_type").agg(F.sum("cnt").alias("type_count"))
    pairs = summ.select(*by, "status_code", "content_type")
    return key_join(key_join(pairs, status, [*by, "status_code"]), types, [*by, "content_type"])


def status_frequency(feats: DataFrame) -> DataFrame:
    return feats.groupBy("status_code").agg(F.count(F.lit(1)).alias("status_count"))


def type_frequency(feats: DataFrame) -> DataFrame:
    return feats.groupBy("content_type").agg(F.count(F.lit(1)).alias("type_count"))


def fingerprint_frequency(feats: DataFrame, order: Sequence[str], descending: bool) -> DataFrame:
    """Per fingerprint: its count and the input position of its last occurrence.

    ``last_pos`` is a DECIMAL ascending in input order when the order keys
    pack (see ``order_code``), else a struct of the keys."""
    code = order_code(feats, order, descending)
    if code is not None:
        last = F.max(code)
    else:
        last = F.min(order_struct(order)) if descending else F.max(order_struct(order))
    return feats.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("fp_count"),
                                            last.alias("last_pos"))


PRUNE_ROWS = 5_000_000  # records from which fingerprints are pruned before they are counted
BUCKETS = 1 << 16
MOST_BUCKETS = 512


def mode_candidates(feats: DataFrame, buckets: int = BUCKETS, most: int = MOST_BUCKETS) -> DataFrame:
    """The rows of ``feats`` whose fingerprint can be the most frequent one, all of them if that can't be told.

    Fingerprints are counted by hash buckets first: a mergeable summary of fixed size (a task sends one
    row per bucket, however many fingerprints there are) that bounds each count from above.  The exact
    best count within the fullest bucket is a lower bound for the mode; buckets below it are out, those
    that reach it stay, ties included.  Where more than ``most`` stay (say all fingerprints are distinct)
    nothing is certain and every row is counted."""
    bucket = F.pmod(F.xxhash64("fingerprint"), F.lit(buckets))
    full = feats.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc()).limit(most + 1).collect()
    if not full:
        return feats
    best = feats.where(bucket == full[0]["b"]).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    stay = [r["b"] for r in full if r["n"] >= best]
    return feats.where(bucket.isin(stay)) if len(stay) <= most else feats


def mode_centroid(feats: DataFrame, order: Sequence[str], descending: bool) -> DataFrame:
    """One row (centroid, centroid_count): the most frequent fingerprint.

    Ties go to the value that reached the top count first while walking the
    input in order, i.e. the one whose last occurrence comes earliest.
    Top-1 of the frequency table (TakeOrderedAndProject: per-task top-1,
    then a merge of one row per task)."""
    fq = fingerprint_frequency(feats, order, descending)
    packed = order_code(feats, order, descending) is not None
    tie = F.col("last_pos").asc() if (packed or not descending) else F.col("last_pos").desc()
    return (fq.orderBy(F.col("fp_count").desc(), tie).limit(1)
            .select(F.col("fingerprint").alias("centroid"), F.col("fp_count").alias("centroid_count")))


def mode_centroid_value(feats: DataFrame, order: Sequence[str], descending: bool) -> int:
    """The mode centroid as a driver-side scalar, hash-aggregate friendly even
    when the order keys do not pack (e.g. a STRING id after created_at).

    The leading key is packed alone; per fingerprint a hash aggregate keeps
    its count and last leading-key position, and the top two by (count desc,
    last asc) come back.  Only when those two tie exactly is the tie broken
    on the remaining keys, over just the tied fingerprints' rows at that
    position (a small struct aggregate).  Exact in every case."""
    order = list(order)
    if order_code(feats, order, descending) is not None or len(order) < 2:
        r = mode_centroid(feats, order, descending).first()
        return int(r["centroid"]) if r is not None else 0
    lead = order_code(feats, order[:1], descending)
    if lead is None:
        r = mode_centroid(feats, order, descending).first()
        return int(r["centroid"]) if r is not None else 0
    fq = feats.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("_c"), F.max(lead).alias("_l"))
    top = fq.orderBy(F.col("_c").desc(), F.col("_l").asc()).limit(2).collect()
    if not top:
        return 0
    if len(top) == 1 or (top[0]["_c"], top[0]["_l"]) != (top[1]["_c"], top[1]["_l"]):
        return int(top[0]["fingerprint"])
    c, last = top[0]["_c"], top[0]["_l"]
    tied = fq.where((F.col("_c") == c) & (F.col("_l") == last)).select("fingerprint")
    rest = order_struct(order[1:])
    rows = feats.where(lead == F.lit(last)).join(tied, "fingerprint", "left_semi")
    # last occurrence among equal leading keys: the extreme remaining key in input order
    per_fp = rows.groupBy("fingerprint").agg((F.min(rest) if descending else F.max(rest)).alias("_r"))
    best = per_fp.orderBy(F.col("_r").desc() if descending else F.col("_r").asc()).limit(1).first()
    return int(best["fingerprint"])


def majority_centroid(feats: DataFrame) -> DataFrame:
    """One row (centroid): bit i set iff more than half of the fingerprints
    have it (the "average fingerprint"; ties give 0).  One aggregate pass."""
    bit = lambda i: F.shiftrightunsigned("fingerprint", i).bitwiseAND(F.lit(1))
    ones = feats.agg(F.count(F.lit(1)).alias("_n"),
                     *[F.sum(bit(i)).alias(f"_o{i}") for i in range(HASH_BITS)])
    fp = F.lit(0).cast("bigint")
    for i in range(HASH_BITS):
        fp = fp.bitwiseOR(F.when(2 * F.col(f"_o{i}") > F.col("_n"),
                                 F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0)))
    return ones.select(fp.alias("centroid"))


def centroid_frame(feats: DataFrame, order: Sequence[str], descending: bool,
                   centroid: str = "mode") -> DataFrame:
    if centroid == "mode":
        return mode_centroid(feats, order, descending).select("centroid")
    if centroid == "majority":
        return majority_centroid(feats)
    raise ValueError(f"unknown centroid rule: {centroid!r}")


@dataclass(frozen=True)
class Stats:
    """Driver-side scalars of one run (a handful of numbers, never rows)."""
    n: int
    sum_length: int
    sum_length_sq: int
    centroid: int

    @property
    def mean(self) -> float:
        return float(self.sum_length) / float(self.n) if self.n else 0.0

    @property
    def sd(self) -> float:
        """Population standard deviation (see ``sigma``); 0 becomes 1 (no division by zero)."""
        if not self.n:
            return 1.0
        sd = math.sqrt(float(self.n * self.sum_length_sq - self.sum_length * self.sum_length)) / self.n
        return sd or 1.0


def collect_stats(feats: DataFrame, order: Sequence[str], descending: bool,
                  centroid: str = "mode", summ: DataFrame | None = None) -> Stats:
    """Driver-side scalars; a ``summary`` at hand saves the pass for the moments."""
    m = (length_moments(feats) if summ is None else moments_of(summ)).first()
    n = int(m["n"] or 0) if m is not None else 0
    s1, s2 = (int(m["sum_length"]), int(m["sum_length_sq"])) if n else (0, 0)
    if n == 0:
        return Stats(0, 0, 0, 0)
    if centroid == "mode":
        return Stats(n, s1, s2, mode_centroid_value(mode_candidates(feats) if n >= PRUNE_ROWS else feats, order, descending))
    c = centroid_frame(feats, order, descending, centroid).first()
    return Stats(n, s1, s2, int(c["centroid"] or 0))


def sigma(n: str | Column, s1: str | Column, s2: str | Column) -> Column:
    """Population standard deviation from exact sums, 0 as 1: the one formula, on columns.  The sum of
    squares times n stays within DECIMAL(38) for 10^10 records of up to a gigabyte."""
    n, s1, s2 = (F.col(x) if isinstance(x, str) else x for x in (n, s1, s2))
    sd = F.sqrt((n.cast(_D) * s2 - s1 * s1).cast("double")) / n
    return F.when(sd == 0, F.lit(1.0)).otherwise(sd)


def profile_frame(feats: DataFrame, order: Sequence[str], descending: bool,
                  centroid: str = "mode") -> DataFrame:
    """One row: n, mean_length, sd_length, centroid (hex) - the dataset profile."""
    m = length_moments(feats)
    cen = centroid_frame(feats, order, descending, centroid).select("centroid").scalar()
    n = F.col("n")
    return m.where(n > 0).select(
        n,
        (F.col("sum_length").cast("double") / n).alias("mean_length"),
        sigma("n", "sum_length", "sum_length_sq").alias("sd_length"),
        fingerprint_hex(cen).alias("centroid"))
