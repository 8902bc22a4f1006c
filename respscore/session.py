"""Session helpers: a sane local session, and reliable materialisation."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "respscore", checkpoint_dir: str | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A local session configured like the cluster one (AQE on, UI off).

    ``checkpoint_dir`` is only applied when the session does not already
    name one in ``spark.checkpoint.dir`` (tests pass a scratch folder)."""
    n = os.cpu_count() if cores == "*" else int(cores)
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or max(2, 2 * n)))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "8g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    if checkpoint_dir and not configured_checkpoint_dir(spark):
        spark.conf.set("spark.checkpoint.dir", checkpoint_dir)
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None for a Spark Connect session (no context)."""
    try:
        return spark.sparkContext
    except Exception:  # pragma: no cover - Spark Connect
        return None


def configured_checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    sc = _context(spark)
    d = sc.getCheckpointDir() if sc is not None else None
    if d:
        return d
    try:
        return spark.conf.get("spark.checkpoint.dir", None) or None
    except Exception:  # pragma: no cover - conf lookup on odd sessions
        return None


_held: list[tuple[SparkSession, str, DataFrame | str]] = []


def materialize(df: DataFrame, how: str = "auto") -> DataFrame:
    """Compute ``df`` once for several downstream consumers.

    * ``table``     - a Parquet table written under ``spark.checkpoint.dir``
      (unique folder) and read back: cuts lineage, survives executor loss,
      and later passes read only the columns they use (column pruning,
      compressed low-cardinality strings).
    * ``checkpoint`` - reliable ``checkpoint()`` into the same folder (row
      format: every later pass reads every column).
    * ``persist``   - MEMORY_AND_DISK cache; a lost block is recomputed
      from lineage (scan + projection), so it also survives executor loss.
    * ``auto``      - ``table`` when a checkpoint folder is configured,
      else ``persist``.
    * ``none``      - keep the plan lazy (every consumer recomputes).

    Tables, checkpoints and cached frames are held until ``release``.
    """
    if how not in ("auto", "table", "checkpoint", "persist", "none"):
        raise ValueError(f"unknown materialize mode: {how!r}")
    if how == "none":
        return df
    spark = df.sparkSession
    cdir = configured_checkpoint_dir(spark)
    if how == "table" or (how == "auto" and cdir):
        if not cdir:
            raise ValueError("table materialisation needs spark.checkpoint.dir")
        path = f"{cdir.rstrip('/')}/respscore-{uuid.uuid4().hex}"
        _held.append((spark, "table", path))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if how == "checkpoint":
        if not cdir:
            raise ValueError("checkpoint requested but spark.checkpoint.dir is not set")
        sc = _context(spark)
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(cdir)
        before = _folders(spark)
        out = df.checkpoint(eager=True)
        _held.extend((spark, "table", path) for path in sorted(_folders(spark) - before))
        return out
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    _held.append((spark, "frame", out))
    out.count()
    return out


def _folders(spark: SparkSession) -> set[str]:
    """The folders of the session's checkpoint folder, one for each frame that was checkpointed."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {str(f.getPath()) for f in store.listStatus(root)} if store.exists(root) else set()


def mark() -> int:
    """A point to release back to."""
    return len(_held)


def release(since: int = 0) -> None:
    """Remove the tables and cached frames that ``materialize`` has made since ``mark()`` (default: all).
    Results that still read them can't be evaluated afterwards; write or collect them first."""
    while len(_held) > since:
        spark, kind, what = _held.pop()
        if kind == "frame":
            what.unpersist()
        else:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(what)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def released() -> Iterator[None]:
    """``with released(): write(rank(history))`` leaves nothing behind."""
    since = mark()
    try:
        yield
    finally:
        release(since)
