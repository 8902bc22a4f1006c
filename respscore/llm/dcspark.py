"""Difference-cover suffix sort over Spark tables, for string sets that fit no single task.

Strings are rows ``(s, i, c)``: string, place in it, symbol from 1 up.  One
level of ``suffix_ranks`` is, as Spark jobs: triples of the sampled places (1
and 2 modulo 3) sorted by range and named by a prefix sum over the parts; the
two strings of names of each string sorted by recursion; the other places
merged in by two more range sorts.  Classes 0 and 1 compare by (symbol, rank
of the next sampled place), then 0 and 2 by (symbol, place in that first
order), so a suffix's rank is a sum of two counts and no comparator is needed.

The end of a string is below every symbol.  Strings have at most some thousand
symbols each (longer texts are cut with an overlap), so that a window over one
string stays small; their number is not bounded.  A symbol, triple or suffix
held by any share of the rows is split, since sorts end in ``(s, i)``.
Only one row per sorted part comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace


def _runs(keys: list[str]):
    """mapInArrow function over one sorted part: ``_part`` and, for the run of equal keys a row is in, how many
    rows (``_start``) and rows of class 0 (``_zeros``) of the part come before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, zeros_seen, start, zeros, last = TaskContext.get().partitionId(), 0, 0, 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(k) for k in keys]
            new = np.zeros(b.num_rows, bool)
            for c in columns:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            mine = [c[0].as_py() for c in columns]
            new[0] = mine != last
            last = [c[-1].as_py() for c in columns]
            zero = b.column("_zero").to_numpy(zero_copy_only=False).astype(np.int64)
            before = zeros_seen + np.cumsum(zero) - zero
            heads = np.flatnonzero(new)
            at = np.cumsum(new)  # 0: the run goes on from the last batch
            starts = np.concatenate([[start], heads + seen])[at]
            zs = np.concatenate([[zeros], before[heads]])[at]
            start, zeros, seen, zeros_seen = int(starts[-1]), int(zs[-1]), seen + b.num_rows, zeros_seen + int(zero.sum())
            more = [pa.array(np.full(b.num_rows, part)), pa.array(starts), pa.array(zs)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "_part", "_start", "_zeros"])

    return run


def number(rows: DataFrame, order: list[str], keys: list[str], ws: Workspace, name: str) -> tuple[DataFrame, bool]:
    """``rows`` (with ``s``, ``i``, and ``_zero``: of class 0) with ``before`` and ``zeros_before``: how many rows, and
    rows of class 0, have lower ``keys``; and whether no two rows have equal ones.  ``order`` sorts the rows
    so that equal keys meet and lower ones come first.  The table is kept under ``name``."""
    by = [*order, "s", "i"]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.LongType()) for n in ("_part", "_start", "_zeros"))])
    done = ws.keep(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_runs(keys), schema), name)
    key = F.struct(*keys)
    parts = done.groupBy("_part").agg(F.count("*").alias("n"), F.sum(F.col("_zero").cast("bigint")).alias("z"), F.max("_start").alias("start"),
                                      F.max("_zeros").alias("zeros"), F.min(key).alias("first"), F.max(key).alias("last"),
                                      F.countDistinct("_start").alias("runs")).collect()
    bases, base, zbase, last, distinct = [], 0, 0, None, True
    for p in sorted(parts, key=lambda p: p["_part"]):
        if last is None or tuple(p["first"]) != last[0]:
            lead, zlead = base, zbase
        else:
            (lead, zlead), distinct = last[1], False  # the run began in an earlier part
        bases.append((p["_part"], base, zbase, lead, zlead))
        distinct &= p["runs"] == p["n"]
        last = (tuple(p["last"]), (lead, zlead) if p["start"] == 0 else (base + p["start"], zbase + p["zeros"]))
        base, zbase = base + p["n"], zbase + p["z"]
    small = rows.sparkSession.createDataFrame(bases, "_part long, _base long, _zbase long, _lead long, _zlead long")
    inside = F.col("_start") > 0
    out = done.join(F.broadcast(small), "_part").select(  # one row per part
        *rows.columns, F.when(inside, F.col("_base") + F.col("_start")).otherwise(F.col("_lead")).alias("before"),
        F.when(inside, F.col("_zbase") + F.col("_zeros")).otherwise(F.col("_zlead")).alias("zeros_before"))
    return out, distinct


def suffix_ranks(strings: DataFrame, depth: int, ws: Workspace, level: str = "dc") -> DataFrame:
    """``s, i, r`` for every row ``(s, i, c)``: ``r`` orders the suffixes by their first ``depth`` symbols at least.
    Suffixes that agree in these take one stretch of values, which no other suffix lies in."""
    along = Window.partitionBy("s").orderBy("i")
    third = F.col("i") % 3
    triples = strings.select("s", "i", "c", F.lead("c", 1, 0).over(along).alias("c1"), F.lead("c", 2, 0).over(along).alias("c2"))
    cover = triples.where(third > 0).withColumn("_zero", F.lit(False))
    names, distinct = number(cover, ["c", "c1", "c2"], ["c", "c1", "c2"], ws, f"{level}_triples")
    sample = names.select("s", "i", F.col("before").alias("r"))
    if not distinct and depth > 3:
        inner = sample.select((F.col("s") * 2 + third - 1).alias("s"), F.floor(F.col("i") / 3).cast("int").alias("i"), (F.col("r") + 1).alias("c"))
        ranks = suffix_ranks(ws.keep(inner, f"{level}_names"), -(-depth // 3), ws, level + "i")
        back = F.col("s") % 2
        sample = ranks.select(F.shiftright("s", 1).alias("s"), (F.col("i") * 3 + back + 1).cast("int").alias("i"), "r")

    # classes 0 and 1 by symbol and the rank of the sampled place that follows
    r1 = F.lead("r", 1, -1).over(along).alias("r1")
    ranked = ws.keep(strings.join(sample, ["s", "i"], "left").select("s", "i", "c", "r", r1), f"{level}_ranked")
    low, _ = number(ranked.where(third < 2).withColumn("_zero", third == 0), ["c", "r1"], ["c", "r1"], ws, f"{level}_low")

    # classes 0 and 2 by symbol and the place that follows in the first order
    j = low.select("s", "i", F.col("before").alias("j"), (F.col("before") - F.col("zeros_before")).alias("ones"), F.col("zeros_before").alias("zeros"))
    j1 = F.lead("j", 1, -1).over(along).alias("j1")
    both = ws.keep(ranked.select("s", "i", "c", "r").join(j, ["s", "i"], "left").select("s", "i", "c", "r", "ones", "zeros", j1), f"{level}_both")
    high, _ = number(both.where(third != 1).withColumn("_zero", third == 0), ["c", "j1"], ["c", "j1"], ws, f"{level}_high")
    one = both.where(third == 1).select("s", "i", (F.col("zeros") + F.col("r")).alias("r"))
    rest = high.select("s", "i", F.when(third == 0, F.col("ones") + F.col("before")).otherwise(F.col("zeros_before") + F.col("r")).alias("r"))
    out = ws.keep(one.unionByName(rest), f"{level}_ranks")
    for name in ("triples", "names", "ranked", "low", "both", "high", "i_ranks"):
        ws.drop(f"{level}_{name}" if name != "i_ranks" else f"{level}i_ranks")
    return out
