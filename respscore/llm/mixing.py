"""Mixing sources to target weights (operator 10) with a multivariate-hypergeometric splitting tree.

Documents of a source are dealt by a keyed hash to blocks of about
``block_words`` words and documents (one that is empty counts too), and the
blocks are put in a seeded permuted order.  A
source's quota is the exact run of blocks, from the front of that order and
round again for repeats, whose words meet its target; the last block is cut
at a document.  The quotas of all sources are then split among the output
shards by a binary tree: each node draws, without replacement, how many
blocks of each source go left, so every shard is a random sample of the mix
and all shards together are exactly the quotas.  Each node has its own seed,
so any task walks from the root to its shards alone.  A shard takes disjoint
runs of the permuted blocks and is shuffled locally.

Choosing documents needs one row per source, which is all that reaches the
driver: sources are named data sets with a weight each.  Texts move once, to
their shard.

Rows equal in id, text and source are folded to one unit with a count before
the plan is made.  A group of more words and rows than a ``PARTS``th of a block
is several units of that much, which are dealt, permuted and cut like other
documents, so no block or shard grows with it.  Its rows (and no others) are written once and
numbered in runs of 2^``RUN_BITS`` to tell which unit each is of; only how many rows a
unit has depends on that, so a second run agrees.

Defined results: a null or empty text has size 0 and is carried along with
its block; a null source is a source of its own, ordered last; rows equal in
id, text and source are taken alike as far as one unit goes (beyond it unit by
unit; under several sources each has its own share); more than ``MOST_SOURCES``
sources are refused; sources without words have target 0; an empty
table gives an empty mix; other columns are carried in a struct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Workspace, row_key, table

# Fixed values of the contract.
WEIGHTS = (3.0, 1.0, 2.0)  # by the source's place in code point order, repeating
SHARE = 1.5                # of all sizes
MOST = 2.0                 # times a source's size

MOST_SOURCES = 100_000  # rows that may reach the driver and be broadcast: one per source

SUPER = 4096  # blocks whose sums are added up before the sums of sums
PARTS = 16  # units of a hot group that fill a block
RUN_BITS = 12  # rows of a hot group are numbered in runs of at most 2^12
STEP = 1 << 16  # units of a hot group that one row makes


@dataclass(frozen=True)
class Mix:
    """Parameters: seed, words to a block, blocks to an output shard."""
    seed: int = 20
    block_words: int = 1 << 18
    shard_blocks: int = 16


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take from each source: ``share`` of all words by weight, none above ``most`` times its
    size; what is above goes to the others by weight until none is."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        rate = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * rate >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * rate
            break
        for i in full:
            out[i] = most * sizes[i]
        left = max(0.0, left - sum(out[i] for i in full))
        open_ = [i for i in open_ if i not in set(full)]
    return out


def shard_quotas(quotas: list[int], shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, blocks) of each source in one shard: the walk from the root of the splitting tree."""
    here, first = np.array(quotas, dtype=np.int64), np.zeros(len(quotas), dtype=np.int64)
    total, low, high = int(here.sum()), 0, shards
    upto = lambda k: total * k // shards
    while high - low > 1:
        mid = (low + high) // 2
        draw = np.random.default_rng([seed, low, high])
        left = draw.multivariate_hypergeometric(here, upto(mid) - upto(low), method="marginals")
        if shard < mid:
            here, high = left, mid
        else:
            here, first, low = here - left, first + left, mid
    return first, here


def _coprime(n: int, seed: int) -> int:
    a = seed % n or 1
    while math.gcd(a, n) > 1:
        a += 1
    return a


def _rows(docs: DataFrame, text: str, source: str) -> DataFrame:
    """``row`` (all columns of ``docs``) beside its key and source."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *row_key("doc_id", text))
    return keyed.select("row", "_k1", "_k2", F.col("row")[source].alias("_source"))


def _dealt(units: DataFrame, seed: int) -> DataFrame:
    """``units`` with the two hashes that deal them; the first unit of a group has its key's."""
    def of(s: int) -> Column:
        key = F.xxhash64(F.lit(s), "_k1", "_k2")
        return F.when(F.col("_chunk") == 0, key).otherwise(F.xxhash64(key, "_chunk"))

    return units.withColumns({"_deal": of(seed), "_turn": of(seed + 1)})


def _units(rows: DataFrame, mix: Mix) -> DataFrame:
    """The rows of one key and source as units of ``_n`` rows, ``_per`` at most, numbered by ``_chunk``."""
    alike = rows.groupBy("_k1", "_k2", "_source").agg(F.max("_size").alias("_size"), F.count(F.lit(1)).alias("_all"))
    sized = alike.withColumn("_per", F.expr(f"greatest(1L, {mix.block_words // PARTS}L div (_size + 1))")).withColumn("_last", F.expr("(_all - 1) div _per"))
    steps = sized.withColumn("_step", F.explode(F.expr(f"sequence(0L, _last div {STEP})")))
    units = steps.withColumn("_chunk", F.explode(F.expr(f"sequence(_step * {STEP}, least(_last, (_step + 1) * {STEP} - 1))")))
    return _dealt(units.select("_k1", "_k2", "_source", "_size", "_per", "_chunk", F.expr("least(_per, _all - _chunk * _per)").alias("_n")), mix.seed)


def _same(a: DataFrame, b: DataFrame, *also: str) -> Column:
    """Rows of ``a`` and ``b`` (its columns named with ``h``) of one key and source."""
    met = a["_k1"].eqNullSafe(b["_h_k1"]) & (a["_k2"] == b["_h_k2"]) & a["_source"].eqNullSafe(b["_h_source"])
    for c in also:
        met &= a[c] == b[f"_h{c}"]
    return met


KEY_TYPE = "struct<t:bigint,n:boolean,k1:bigint,k2:bigint,c:bigint>"


def _key() -> Column:
    """The order of units in a block."""
    return F.struct(F.col("_turn").alias("t"), F.col("_k1").isNull().alias("n"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), F.col("_chunk").alias("c"))


class Plan:
    """What a mix takes from each source; ``sources`` has one dict per source, in code point order."""

    def __init__(self, sized: DataFrame, mix: Mix, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST):
        spark = sized.sparkSession
        found = sized.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("size"), F.sum("_n").alias("rows")).orderBy(F.asc_nulls_last("_source")).limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        weigh = [weights[i % len(weights)] for i in range(len(found))]
        wanted = targets([r["size"] for r in found], weigh, share, most)
        self.sources = []
        for i, (r, t) in enumerate(zip(found, wanted, strict=True)):
            blocks = max(1, math.ceil((r["size"] + r["rows"]) / mix.block_words))
            whole = min(int(most), int(t // r["size"])) if r["size"] else 0
            self.sources.append({"s": i, "source": r["_source"], "size": r["size"], "target": t, "blocks": blocks,
                                 "by": _coprime(blocks, mix.seed * 2654435761 + i * 40503), "plus": (mix.seed + 7919 * i) % blocks,
                                 "whole": whole, "rest": t - whole * r["size"]})
        self.spark, self.mix, self.sized = spark, mix, sized
        self._cut(sized)
        quotas = [x["whole"] * x["blocks"] + x["full"] + (x["cut"] is not None or x["more"] is not None) for x in self.sources]
        self.quotas, self.shards = quotas, max(1, math.ceil(sum(quotas) / mix.shard_blocks))

    def _frame(self, *names: str) -> DataFrame:
        kinds = {"s": "int", "source": "string", "size": "long", "target": "double", "blocks": "long", "by": "long", "plus": "long", "whole": "int",
                 "rest": "double", "full": "long", "cut": KEY_TYPE, "more": KEY_TYPE}
        rows = [tuple(x[n] for n in names) for x in self.sources]
        return self.spark.createDataFrame(rows, ", ".join(f"_p_{n} {kinds[n]}" for n in names))

    def numbered(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the ``_chunk`` of their group that each is of."""
        hot = self.sized.where("_chunk = 1").select(*[F.col(c).alias(f"_h{c}") for c in ("_k1", "_k2", "_source")], "_per")
        if hot.isEmpty():
            return rows.withColumn("_chunk", F.lit(0).cast("bigint"))
        met = rows.join(hot, _same(rows, hot), "left").select(*rows.columns, "_per")
        cold = met.where("_per IS NULL").select(*rows.columns, F.lit(0).cast("bigint").alias("_chunk"))
        kept = Workspace(self.spark, "mix-hot").keep(met.where("_per IS NOT NULL").withColumn("_m", F.monotonically_increasing_id()), "rows")
        kept = kept.withColumn("_run", F.shiftright("_m", RUN_BITS))
        group = ["_k1", "_k2", "_source"]
        runs = kept.groupBy(*group, "_run").agg(F.count(F.lit(1)).alias("_rows"))
        before = F.sum("_rows").over(Window.partitionBy(*group).orderBy("_run")) - F.col("_rows")
        first = runs.select(*[F.col(c).alias(f"_h{c}") for c in (*group, "_run")], before.alias("_before"))
        nth = F.row_number().over(Window.partitionBy(*group, "_run").orderBy("_m"))
        in_run = kept.withColumn("_nth", nth)
        warm = in_run.join(first, _same(in_run, first, "_run")).select(*rows.columns, F.expr("(_before + _nth - 1) div _per").alias("_chunk"))
        return cold.unionByName(warm)

    def place(self, rows: DataFrame, *more: str) -> DataFrame:
        """``rows`` with their source's plan and ``_pos``, their block's place in the permuted order."""
        p = self._frame("s", "source", "blocks", "by", "plus", *more)
        at = rows.join(p, rows["_source"].eqNullSafe(p["_p_source"])).drop("_p_source")
        block = F.pmod(F.col("_deal"), F.col("_p_blocks"))
        return at.withColumn("_pos", F.pmod(block * F.col("_p_by") + F.col("_p_plus"), F.col("_p_blocks"))).drop("_p_by", "_p_plus")

    def _cut(self, sized: DataFrame) -> None:
        """Find each source's last block and what it gives: documents in order while they fit the target,
        then the one whose size comes nearest to what is left, if that is nearer than none."""
        placed = self.place(sized, "rest")
        blocks = placed.groupBy("_p_s", "_p_rest", "_pos").agg(F.sum(F.col("_size") * F.col("_n")).alias("words"))
        upper = blocks.groupBy("_p_s", F.floor(F.col("_pos") / SUPER).alias("sup")).agg(F.sum("words").alias("words"))
        before = upper.select("_p_s", "sup", (F.sum("words").over(Window.partitionBy("_p_s").orderBy("sup")) - F.col("words")).alias("base"))
        inner = Window.partitionBy("_p_s", "sup").orderBy("_pos")
        sums = blocks.withColumn("sup", F.floor(F.col("_pos") / SUPER)).join(before, ["_p_s", "sup"]).select(
            "_p_s", "_p_rest", "_pos", "words", (F.col("base") + F.sum("words").over(inner)).alias("upto"))
        lasts = sums.where("_p_rest > 0 AND upto > _p_rest").groupBy("_p_s").agg(F.min(F.struct("_pos", (F.col("upto") - F.col("words")).alias("before"))).alias("at"))
        ends = {r["_p_s"]: r["at"] for r in lasts.collect()}  # the first block that does not fit; places before it may be empty
        for x in self.sources:
            end = ends.get(x["s"])
            x["full"] = 0 if end is None else end["_pos"]
            x["left"] = x["rest"] - (0 if end is None else end["before"])
            x["cut"] = x["more"] = None
        last = self.spark.createDataFrame([(x["s"], x["full"], x["left"]) for x in self.sources if x["rest"] > 0], "_l_s int, _l_pos long, _l_left double")
        inside = placed.join(last, (F.col("_p_s") == F.col("_l_s")) & (F.col("_pos") == F.col("_l_pos")))
        each = inside.select("_p_s", "_l_left", _key().alias("key"), (F.col("_size") * F.col("_n")).alias("words"))
        whole = Window.partitionBy("_p_s")
        so_far = F.sum("words").over(whole.orderBy("key"))
        summed = each.select("_p_s", "key", "words", "_l_left", so_far.alias("upto"))
        fits = F.col("upto") <= F.col("_l_left")
        gap = F.col("_l_left") - F.coalesce(F.max(F.when(fits, F.col("upto"))).over(whole), F.lit(0))
        off = F.abs(gap - F.col("words"))
        judged = summed.select("_p_s", "key", fits.alias("fits"), F.when(~fits & (off < gap), off).alias("off"))
        for r in judged.groupBy("_p_s").agg(F.max(F.when(F.col("fits"), F.col("key"))).alias("cut"), F.min(F.when(F.col("off").isNotNull(), F.struct("off", "key"))).alias("more")).collect():
            self.sources[r["_p_s"]] |= {"cut": r["cut"] and tuple(r["cut"]), "more": r["more"] and tuple(r["more"]["key"])}

    def shard_runs(self) -> DataFrame:
        """``_p_s, _at, shard``: which shard takes each block of each source's run.  A task walks the tree for its shards."""
        quotas, shards, seed = self.quotas, self.shards, self.mix.seed

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard in b.column("id").to_pylist():
                    first, n = shard_quotas(quotas, shards, shard, seed)
                    s = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(first[s]), pa.array(n[s]), pa.array(np.full(len(s), shard))],
                                                     names=["s", "first", "n", "shard"])

        runs = self.spark.range(shards).mapInArrow(walk, "s int, first long, n long, shard long")
        return runs.select(F.col("s").alias("_r_s"), F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("_r_at"), "shard")


def make_plan(docs: DataFrame, text: str = "text", source: str = "source", mix: Mix = Mix(), weights: tuple[float, ...] = WEIGHTS,
              share: float = SHARE, most: float = MOST) -> Plan:
    ws = Workspace(docs.sparkSession, "mix")
    rows = _rows(docs.select("doc_id", text, source), text, source)
    size = F.regexp_count(F.coalesce(F.col("row")[text], F.lit("")), F.lit(WORD)).cast("bigint")
    return Plan(ws.keep(_units(rows.select("_k1", "_k2", "_source", size.alias("_size")), mix), "sized"), mix, weights, share, most)


def take(rows: DataFrame, plan: Plan) -> DataFrame:
    """One row for each time that the mix takes a row of ``rows`` (documents, or units): with ``copy``, ``shard`` and ``local_order``."""
    if "_chunk" not in rows.columns:
        rows = plan.numbered(rows)
    key = _key()
    placed = plan.place(_dealt(rows, plan.mix.seed), "whole", "full", "cut", "more")
    in_last = F.coalesce(key <= F.col("_p_cut"), F.lit(False)) | key.eqNullSafe(F.col("_p_more"))
    once_more = (F.col("_pos") < F.col("_p_full")) | ((F.col("_pos") == F.col("_p_full")) & in_last)
    copies = F.col("_p_whole") + once_more.cast("int")
    runs = plan.shard_runs().join(plan._frame("s", "blocks").withColumnRenamed("_p_s", "_r_s"), "_r_s").select(
        "_r_s", F.pmod("_r_at", "_p_blocks").alias("_r_pos"), F.floor(F.col("_r_at") / F.col("_p_blocks")).cast("int").alias("copy"), "shard")
    some = placed.withColumn("_copies", copies).where("_copies > 0")
    each = some.join(runs, (some["_p_s"] == runs["_r_s"]) & (some["_pos"] == runs["_r_pos"]) & (runs["copy"] < some["_copies"]))
    return each.select(*rows.columns, "copy", "shard", F.xxhash64(F.lit(plan.mix.seed + 2), "_turn", "copy").alias("local_order"))


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", mix: Mix = Mix(), weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix: the rows of ``docs``, as often as it takes them, dealt to shards and shuffled inside each.
    The columns of ``docs``; partitions hold whole shards, in the shard's random order."""
    plan = make_plan(docs, text, source, mix, weights)
    taken = take(_rows(docs, text, source), plan)
    return taken.repartition("shard").sortWithinPartitions("shard", "local_order").select("row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = make_plan(docs)
    units = plan.sized.select("_k1", "_k2", "_source", "_chunk", "_size", "_n")
    times = take(units, plan).groupBy("_k1", "_k2", "_source", "_chunk").agg(F.count(F.lit(1)).alias("_times"))  # one text may stand in several sources
    times = times.select(*[F.col(c).alias(f"_h{c}") for c in ("_k1", "_k2", "_source", "_chunk")], "_times")
    counted = units.join(times, _same(units, times, "_chunk"), "left").select(
        F.col("_k1").alias("doc_id"), F.col("_size").alias("size"), "_source", "_n", (F.col("_size") * F.coalesce("_times", F.lit(0))).alias("taken"))
    p = plan._frame("source", "size", "target")
    out = counted.join(p, counted["_source"].eqNullSafe(p["_p_source"])).select(
        "doc_id", "size", F.col("_p_size").alias("source_size"), F.col("_p_target").alias("target"), "taken", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_i"))
    return out.drop("_i")
