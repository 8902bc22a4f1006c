"""Score new traffic against a frozen baseline, in batch or as a stream.

``fit_baseline`` runs the batch statistics once (count, exact length
moments, centroid, status and MIME frequency tables) and can store them.
``score`` then ranks any DataFrame - including a ``readStream`` - against
those frozen statistics with a stateless plan: scalars are literals, the
frequency tables are static lookup sides (plain stream-static left joins).  A status or MIME type the baseline never
saw has frequency 0, i.e. rarity 1.  With no state, every micro-batch is
independent and a restarted query simply resumes from its checkpoint.

Scoring the baseline's own data reproduces ``rank`` exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import response_features
from ..operators.joins import key_join
from ..operators.profile import Stats, collect_stats, status_frequency, type_frequency
from ..operators.score import RESULT_COLUMNS, score_columns
from ..session import materialize


@dataclass
class Baseline:
    stats: Stats
    status_freq: DataFrame      # status_code, status_count
    type_freq: DataFrame        # content_type, type_count
    max_body_units: int | None = None


def fit_baseline(history: DataFrame, order: Sequence[str] = ("created_at", "id"),
                 descending: bool = True, centroid: str = "mode",
                 max_body_units: int | None = None,
                 materialize_how: str = "auto") -> Baseline:
    feats = materialize(response_features(history, list(order), max_body_units), materialize_how)
    stats = collect_stats(feats, list(order), descending, centroid)
    sfreq = materialize(status_frequency(feats), materialize_how)
    tfreq = materialize(type_frequency(feats), materialize_how)
    return Baseline(stats, sfreq, tfreq, max_body_units)


def save_baseline(b: Baseline, path: str) -> None:
    spark = b.status_freq.sparkSession
    s = b.stats
    spark.createDataFrame([(s.n, str(s.sum_length), str(s.sum_length_sq), s.centroid)],
                          "n bigint, sum_length string, sum_length_sq string, centroid bigint") \
        .write.mode("overwrite").parquet(f"{path}/scalars")
    b.status_freq.write.mode("overwrite").parquet(f"{path}/status_freq")
    b.type_freq.write.mode("overwrite").parquet(f"{path}/type_freq")


def load_baseline(spark: SparkSession, path: str,
                  max_body_units: int | None = None) -> Baseline:
    r = spark.read.parquet(f"{path}/scalars").first()   # one row of scalars
    stats = Stats(int(r["n"]), int(r["sum_length"]), int(r["sum_length_sq"]), int(r["centroid"]))
    return Baseline(stats, spark.read.parquet(f"{path}/status_freq"),
                    spark.read.parquet(f"{path}/type_freq"), max_body_units)


def score(df: DataFrame, b: Baseline, order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """Rank ``df`` (batch or streaming) against the frozen baseline; unordered."""
    feats = response_features(df, list(order), b.max_body_units)
    j = key_join(feats, b.status_freq, "status_code", "left")
    j = key_join(j, b.type_freq, "content_type", "left")
    j = j.fillna(0, subset=["status_count", "type_count"])
    sc = score_columns(b.stats)
    extra = [c for c in order if c not in RESULT_COLUMNS]
    cols = [sc["rank"].alias("rank") if c == "rank" else F.col(c) for c in RESULT_COLUMNS]
    return j.select(*cols, *[F.col(c) for c in extra])
