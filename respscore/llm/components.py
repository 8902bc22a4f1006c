"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _closer(pairs: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """``u, v`` with ``m``: the least of u and its neighbours.  The minimum is combined in each task
    and kept as a table, so the join reads two plain inputs and a hot ``u`` can be split."""
    least = ws.keep(pairs.groupBy("u").agg(F.min("v").alias("_min")).select("u", F.least("u", "_min").alias("m")), name)
    return pairs.join(least, "u")


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``node``, ``root`` for each node that is not the least of its component (BIGINT ids).

    ``edges`` has columns ``a, b``; direction and repeats don't matter.  Each round links every
    node's larger neighbours, then its smaller ones, to its least neighbour; what is left at the
    end is one star per component.  Rounds grow with the logarithm of a component's width.  Only
    a count and a checksum reach the driver."""
    stars = ws.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars0")
    state, turn = None, 0
    while True:
        now = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(now) == state or now["n"] == 0:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, turn = tuple(now), turn + 1
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _closer(both, ws, f"large_min{turn}").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = ws.keep(large.where("u <> v").distinct(), f"large{turn}")
        linked = _closer(large, ws, f"small_min{turn}")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))
        stars = ws.keep(small.where("u <> v").distinct(), f"stars{turn}")
        for old in (f"stars{turn - 1}", f"large_min{turn}", f"large{turn}", f"small_min{turn}"):
            ws.drop(old)
