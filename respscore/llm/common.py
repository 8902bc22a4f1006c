"""Shared helpers of the training-data operators: scratch tables, text rules.

Scratch tables live in the shared folder that the session names in
``spark.checkpoint.dir``; one is made only in local mode, where it is unset.
"""

from __future__ import annotations

import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configured_checkpoint_dir

# Fixed values of the contracts: white space is 0x20 and 0x09-0x0D, a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

# Python tasks get these modules' code with the function they run, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables and output files, with its store's scheme: a path without one is
    in Spark's default file system, which tasks that write files by themselves could not tell."""
    named = configured_checkpoint_dir(spark)
    if named:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="respscore-llm-")
    spark.conf.set("spark.checkpoint.dir", made)
    return shared_dir(spark)


class Workspace:
    """A unique folder of scratch tables below the shared folder.

    ``keep`` writes a table and reads it back (cuts lineage; survives the
    loss of executors); ``drop`` removes one that nothing reads any more.
    What a lazy result still reads stays until ``release()``; the folder of
    a finished query may also be removed by the folder's retention rule."""

    _open: list["Workspace"] = []

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/llm-{what}-{uuid.uuid4().hex}"
        Workspace._open.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.path}/{name}")

    def release(self) -> None:
        _delete(self.spark, self.path)
        if self in Workspace._open:
            Workspace._open.remove(self)


def release_all() -> None:
    """Remove every scratch folder this driver still holds (their results can't be read afterwards)."""
    for w in list(Workspace._open):
        w.release()


def _delete(spark: SparkSession, path: str) -> None:
    if path.startswith(("file:/", "/")):
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    jvm = spark.sparkContext._jvm  # any other store: through Spark's own file system
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once a row however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else (``lower`` does just that where all is ASCII, and is much faster)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def with_struct(df: DataFrame, value: Column) -> DataFrame:
    """``df`` plus the fields of a struct, evaluated once a row (a generator is not inlined into filters)."""
    return df.select("*", F.inline(F.array(value)))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """``_k1``, ``_k2``: names a row by its id and its text; rows equal in both are one document."""
    return [F.col(doc_id).cast("bigint").alias("_k1"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_k2")]


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that stand for much work each (files, blocks), dealt over all shuffle partitions: a stated
    number, which AQE does not fold because the rows themselves are small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def each_batch(kernel: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies ``kernel`` to each batch that has rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield kernel(b)
    return run


def slices(lengths: list[int] | object, most: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive rows whose lengths sum to ``most`` or less (a longer row alone)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_slices(b: pa.RecordBatch, text: str, beside: str, most: int = 12 << 20) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The text column of a batch, and another, in runs of rows of about ``most`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
    for start, end in slices(sizes.tolist(), most):
        yield b.column(text).slice(start, end - start), b.column(beside).slice(start, end - start)
