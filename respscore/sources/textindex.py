"""An index of tokens to files, for predicates that ask whether a text contains something.

``build_index`` lists the distinct word tokens of every file of a table.  A
text that contains a needle holds, for each run of letters and digits of the
needle, a token that contains this run: equal to it inside the needle, ending
with it at the needle's beginning, beginning with it at its end.  Files that
lack such a token cannot hold the needle and are not read; the exact predicate
then runs on the others.  A needle without any letter or digit reads all files.

The index grows with the distinct tokens of a file, which is far less than its
text, and one search reads the index's token column alone.  It belongs to the
files it was made from: a table that is rewritten needs a new one, and files
that the index does not know are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import TOKEN_PATTERN
from ..functions.text import tokens


def build_index(table: DataFrame, path: str, text: str = "body") -> None:
    """Write the index of a table that is read from files: ``token, file``, sorted by token, and ``file``
    alone for each file, so that one without tokens is known too.  Tokens are made distinct in each task
    before the shuffle."""
    each = table.select(F.input_file_name().alias("file"), F.col(text).alias("_t"))
    pairs = each.select("file", F.explode(F.array_distinct(tokens("_t"))).alias("token")).distinct()
    pairs.select("token", "file").repartitionByRange("token").sortWithinPartitions("token", "file").write.parquet(f"{path}/tokens")
    each.select("file").distinct().write.parquet(f"{path}/files")


def needle_runs(needle: str) -> list[tuple[str, bool, bool]]:
    """(run, whether the token begins with it, whether it ends with it) for each run of token characters of
    a needle.  A run at the needle's edge may be part of a longer token there."""
    low = needle.lower()
    return [(m.group(), m.start() > 0, m.end() < len(low)) for m in re.finditer(TOKEN_PATTERN, low)]


def _holds(run: str, begins: bool, ends: bool) -> Column:
    token = F.col("token")
    if begins and ends:
        return token == run
    return token.startswith(run) if begins else token.endswith(run) if ends else token.contains(run)


def candidate_files(spark: SparkSession, path: str, needle: str) -> list[str] | None:
    """Files that may hold ``needle``, or None if the index can't tell.  One row per file reaches the driver,
    as a scan's own list of files does."""
    runs = needle_runs(needle)
    if not runs:
        return None
    index = spark.read.parquet(f"{path}/tokens")
    tests = [_holds(*r) for r in runs]
    some = index.where(_any(tests)).groupBy("file").agg(*[F.max(t).alias(f"r{k}") for k, t in enumerate(tests)])
    return [r["file"] for r in some.where(" AND ".join(f"r{k}" for k in range(len(tests)))).select("file").collect()]


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def search_files(table: DataFrame, path: str, needle: str) -> list[str]:
    """The files of ``table`` that a search reads: those the index names, and those it does not know."""
    spark = table.sparkSession
    wanted = candidate_files(spark, path, needle)
    files = table.inputFiles()
    if wanted is None:
        return files
    plain = lambda f: re.sub(r"^file:/*", "/", f)
    known = {plain(r["file"]) for r in spark.read.parquet(f"{path}/files").collect()}
    may = {plain(f) for f in wanted}
    return [f for f in files if plain(f) in may or plain(f) not in known]


def search(table: DataFrame, path: str, needle: str, text: str = "body") -> DataFrame:
    """The rows of a Parquet table whose text contains ``needle``, reading only files that may hold it."""
    files = search_files(table, path, needle)
    hit = F.coalesce(F.col(text).contains(needle), F.lit(False))
    if not files:
        return table.where(F.lit(False))
    return table.sparkSession.read.schema(table.schema).parquet(*files).where(hit)
