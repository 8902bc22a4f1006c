"""Stored runs: rank results kept under a run key with their summary, read
back without recomputing, reused for a known key, and cleared.

A store holds two Parquet tables: ``results``, partitioned by ``run`` (a hash
of the run key, so a key of any length names a folder), and ``index``, one
row per run with the key itself, the time and the summary.  Saving a run
overwrites only its own partitions (dynamic partition overwrite), the index
last, so a run that is in the index is whole.  The last run is found in the
index alone.  A store that was never written reads as empty.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.annotate import is_high


def id_set_key(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """One row ``run_key``: an order-insensitive digest of an id list.

    Built from per-id MD5 prefixes (count, sum, xor), so it needs no
    collect of the ids, is the same for any row order and changes when an
    id is added, dropped or repeated."""
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 15), 16, 10).cast("bigint")
    agg = ids.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"),
                  F.bit_xor(h).alias("x"))
    key = F.concat(F.lit("ids:"), F.sha2(F.concat_ws(":", F.col("n").cast("string"),
                                                     F.col("s").cast("string"),
                                                     F.col("x").cast("string")), 256))
    return agg.select(key.alias("run_key"))


DIGEST_LANES = 4
_MODULUS = str(1 << 64)


def id_digest(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """One row ``n, lane0 .. lane3``: a digest of an id list as a multiset.  A lane is the sum, modulo 2^64, of a
    quarter of each id's SHA-256, so digests of lists add and subtract (``combine_digests``): 256 bits, no
    order, repeats counted, and a changed list's digest from the old one and the change alone."""
    sha = F.sha2(F.col(id_col).cast("string"), 256)
    lane = lambda k: F.conv(F.substring(sha, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = [F.pmod(F.coalesce(F.sum(lane(k)).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")), F.expr(f"cast('{_MODULUS}' as decimal(38,0))")).cast("decimal(20,0)").alias(f"lane{k}")
            for k in range(DIGEST_LANES)]
    return ids.agg(F.count(id_col).alias("n"), *sums)


def combine_digests(base: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The digest of a list from its old one, that of the ids added and that of the ids removed."""
    parts = [base.withColumn("_s", F.lit(1))] + [d.withColumn("_s", F.lit(s)) for d, s in ((added, 1), (removed, -1)) if d is not None]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    wide = lambda c: F.sum(F.col(c).cast("decimal(30,0)") * F.col("_s").cast("decimal(2,0)")).cast("decimal(38,0)")
    mod = F.expr(f"cast('{_MODULUS}' as decimal(38,0))")
    return rows.agg(wide("n").cast("bigint").alias("n"), *[F.pmod(wide(f"lane{k}"), mod).cast("decimal(20,0)").alias(f"lane{k}") for k in range(DIGEST_LANES)])


def digest_key(digest: DataFrame) -> DataFrame:
    """One row ``run_key`` for a digest (``id_digest``, ``combine_digests``)."""
    return digest.select(F.concat(F.lit("ids:"), F.sha2(F.concat_ws(":", "n", *[F.col(f"lane{k}").cast("string") for k in range(DIGEST_LANES)]), 256)).alias("run_key"))


def scan_key(limit: int, scan_all: bool, filter: str | None = None, version: str = "") -> str:
    """Key of a history scan; ``version`` should name the data snapshot
    (e.g. the table version or max created_at) so new traffic is a new run."""
    return f"scan:{limit}:{str(bool(scan_all)).lower()}:{(filter or '').strip()}:{version}"


def history_version(history: DataFrame) -> str:
    """A data-version string for ``scan_key`` from one aggregate: record count, newest created_at and an
    order-free digest of each record's id, time, status and size, so replaced records change it too."""
    parts = [c for c in ("id", "created_at", "status_code", "content_length", "fingerprint") if c in history.columns]
    size = [F.octet_length("body")] if "body" in history.columns else []
    r = history.agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("t"),
                    F.sum(F.xxhash64(*parts, *size).cast("decimal(38,0)")).alias("x")).first()
    return f"{r['n']}@{r['t'].isoformat() if r['t'] is not None else ''}#{r['x'] or 0}"


INDEX = ("run string, run_key string, saved_at timestamp, total_requests bigint, high_requests bigint, "
         "max_rank int, duration_ms double")
RESULTS = ("id string, rank int, method string, url string, status_code int, content_length bigint, "
           "content_type string, location string")


def run_name(run_key: str) -> str:
    """The folder name of a run key."""
    return hashlib.sha256(run_key.encode()).hexdigest()[:32]


def _table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table of the store; empty (with ``schema``) before the first run."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.parquet(path) if not isinstance(schema, str) or schema != INDEX else spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def run_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored run: run, run_key, saved_at and its summary."""
    return _table(spark, f"{path}/index", INDEX)


def _write(df: DataFrame, path: str, run: str) -> None:
    (df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run").parquet(path))


def save_run(results: DataFrame, path: str, run_key: str, duration_ms: float | None = None) -> None:
    """Write ``results`` as run ``run_key`` with its summary, replacing only that run."""
    run = run_name(run_key)
    _write(results, f"{path}/results", run)
    stored = results.sparkSession.read.schema(results.schema).parquet(f"{path}/results/run={run}")
    summary = run_summary(stored, duration_ms).withColumnRenamed("timestamp", "saved_at")
    _write(summary.withColumn("run_key", F.lit(run_key)).select("run_key", "saved_at", "total_requests", "high_requests", "max_rank", "duration_ms"),
           f"{path}/index", run)


def load_run(spark: SparkSession, path: str, run_key: str,
             schema: T.StructType | None = None) -> DataFrame:
    """Stored results of one run (only its files are read); empty if there is no such run, with
    ``schema``'s columns, else those of the store."""
    return _load(spark, path, run_name(run_key), schema)


def _load(spark: SparkSession, path: str, run: str, schema: T.StructType | None) -> DataFrame:
    runs = _table(spark, f"{path}/results", schema or RESULTS)
    return (runs.where(F.col("run") == run) if "run" in runs.columns else runs.limit(0)).drop("run")


def last_run(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The most recently saved run, read back without recomputing it; empty before the first run."""
    last = run_index(spark, path).orderBy(F.col("saved_at").desc(), "run").limit(1).select("run").first()
    return _load(spark, path, last["run"] if last else "", schema)


def load_or_compute(spark: SparkSession, path: str, run_key: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The stored run of a known key, else ``compute()``, saved and read back."""
    if not run_index(spark, path).where(F.col("run") == run_name(run_key)).limit(1).count():
        begun = time.monotonic()
        results = compute()
        save_run(results, path, run_key)
        _stamp(spark, path, run_key, (time.monotonic() - begun) * 1000)
    return load_run(spark, path, run_key)


def _stamp(spark: SparkSession, path: str, run_key: str, duration_ms: float) -> None:
    run = run_name(run_key)
    row = run_index(spark, path).where(F.col("run") == run).first()
    kept = spark.createDataFrame([row], run_index(spark, path).schema).drop("run").withColumn("duration_ms", F.lit(duration_ms))
    _write(kept, f"{path}/index", run)


def run_summary(results: DataFrame, duration_ms: float | None = None) -> DataFrame:
    """One row: total_requests, high_requests, max_rank, duration_ms, timestamp."""
    return results.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(is_high()).alias("high_requests"),
        F.max("rank").alias("max_rank"),
    ).select("*", F.lit(duration_ms).cast("double").alias("duration_ms"),
             F.current_timestamp().alias("timestamp"))


def clear_runs(spark: SparkSession, path: str) -> None:
    """Empty the store (every run): the index first, so no run is listed without its results."""
    for name in ("index", "results"):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
