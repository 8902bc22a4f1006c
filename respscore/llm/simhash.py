"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 1).

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each a
word of the Golay code [23, 12] (padded with zero bits).  Decoding a segment,
and its one-bit neighbours, gives codeword indices that two words at most one
bit apart share.  Up to three differing bits can fall on the segments in two
ways: at most one on each, so the three index sets all meet; or two or more on
one segment, so another is equal and the third has one at most.  Keys for
both, of 33 bits and more, join every linked pair, and the pairs are verified.

Distinct fingerprints alone are joined (equal ones are linked by value).  A
bucket emits a spanning forest of its links, never all its pairs.

Defined results: a null or empty text, or one without a word, has fingerprint
zero and is linked like any other; fewer words than a shingle hash as one
sequence; repeated rows are linked; a null id takes part but names no
component unless all ids of the component are null; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, each_batch, row_key, table
from .components import components
from .golay import nearby

# Fixed values of the contract.
SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # shift and width
BUCKET = 1 << 16  # members of a bucket that one task holds at once; larger buckets are joined chunk by chunk
_CHUNK = 1 << 16  # shingles counted at once
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


# ------------------------------------------------------------------ fingerprints
def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Unsigned SimHash of one text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six white space bytes
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    stop = ends[min(width, len(words)) - 1:] - 1
    digest, ones = xxhash.xxh64_digest, np.zeros((8, 8), dtype=np.int64)
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at:at + _CHUNK].tolist(), stop[at:at + _CHUNK].tolist(), strict=False)
        raw = np.frombuffer(b"".join([digest(line[s:e], SEED) for s, e in spans]), np.uint8).reshape(-1, 8)
        seen = np.bincount((raw + np.arange(8, dtype=np.int64) * 256).ravel(), minlength=2048).reshape(8, 256)
        ones += seen @ _BYTE_BITS
    return int.from_bytes(np.packbits((2 * ones > n).astype(np.uint8)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", carry: list[str] | None = None, width: int = SHINGLE_WORDS) -> DataFrame:
    """The ``carry`` columns (default ``doc_id``) and ``fp``, the fingerprint's 64 bits as BIGINT.  No shuffle."""
    narrow = docs.select(*(carry or ["doc_id"]), F.col(text).alias("_text"))
    kept = [f for f in narrow.schema.fields if f.name != "_text"]

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = [_signed(fingerprint(t.as_py(), width)) for t in b.column("_text")]
        return pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(fps, pa.int64())], names=[*[f.name for f in kept], "fp"])

    schema = narrow.drop("_text").schema.add("fp", "long")
    return narrow.mapInArrow(each_batch(kernel), schema)


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


# ------------------------------------------------------------------ keys
def _product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, every value of ``a`` (shifted) with every value of ``b``."""
    (na, va), (nb, vb) = a, b
    n = na * nb
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    left = va[np.repeat(np.cumsum(na) - na, n) + at // nb[row]]
    right = vb[np.repeat(np.cumsum(nb) - nb, n) + at % nb[row]]
    return n, left << shift | right


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) such that any two fingerprints (uint64) within three bits share a key."""
    words = [(fps >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in SEGMENTS]
    near = [nearby(x, w) for x, (_, w) in zip(words, SEGMENTS, strict=True)]
    exact = [(np.ones(len(x), np.int64), x.astype(np.int64)) for x in words]
    sets = [_product(exact[i], near[j], 12) for i, j in permutations(range(3), 2)]
    sets.append(_product(_product(near[0], near[1], 12), near[2], 12))
    rows = np.concatenate([np.repeat(np.arange(len(n)), n) for n, _ in sets])
    return rows, np.concatenate([v | kind << 40 for kind, (_, v) in enumerate(sets)])


def _emit_keys(b: pa.RecordBatch) -> pa.RecordBatch:
    fps = b.column("fp").to_numpy(zero_copy_only=False)
    rows, keys = golay_keys(fps.view(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fps[rows], pa.int64())], names=["key", "fp"])


# ------------------------------------------------------------------ links
def forest(fps: np.ndarray, max_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (a, b) that span the components of fingerprints within ``max_bits`` of each other."""
    left, right, rest = [], [], fps
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            for x in queue.pop():
                hit = np.bitwise_count(rest ^ x) <= max_bits
                if hit.any():
                    found, rest = rest[hit], rest[~hit]
                    left.append(np.full(len(found), x))
                    right.append(found)
                    queue.append(found)
    return left, right


def _links(max_bits: int, bucket: int):
    """mapInArrow function over rows sorted by ``key``: verified links as (-1, a, b).  A bucket of
    more than ``bucket`` members is linked chunk by chunk, and its members are handed on as
    (chunk, key, fingerprint) for the links between chunks."""
    schema = pa.schema([("chunk", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def out(chunk, a, b) -> pa.RecordBatch:
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), chunk)), pa.array(a), pa.array(b)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, chunk = None, [], 0

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, chunk
            fps = np.concatenate(held)
            if chunk or not last:
                yield out(chunk, [np.full(len(fps), key)], [fps.view(np.int64)])
            if len(fps) > 1:
                left, right = forest(fps, max_bits)
                if left:
                    yield out(-1, left, right)
            held, chunk = [], chunk + 1

        for b in batches:
            keys, fps = b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            bounds = np.concatenate([[0], cuts, [len(keys)]])
            sizes = np.diff(bounds)
            pairs = bounds[:-1][(sizes == 2) & (bounds[:-1] > 0) & (bounds[1:] < len(keys))]  # whole buckets of two, at once
            near = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= max_bits]
            if len(near):
                yield out(-1, [fps[near]], [fps[near + 1]])
            inner = (bounds[:-1] > 0) & (bounds[1:] < len(keys))
            for s, e in zip(bounds[:-1][~(inner & (sizes <= 2))].tolist(), bounds[1:][~(inner & (sizes <= 2))].tolist(), strict=True):
                if keys[s] != key:
                    if held:
                        yield from close(True)
                    key, held, chunk = keys[s], [], 0
                for at in range(s, e, bucket):
                    part = fps[at:min(e, at + bucket)]
                    room = bucket - sum(map(len, held))
                    held.append(part[:room])
                    if len(part) > room:
                        yield from close(False)
                        held = [part[room:]]
        if held:
            yield from close(True)

    return run


def _between_chunks(found: DataFrame, max_bits: int, bucket: int) -> DataFrame:
    """Links between the chunks of buckets that were too large for one: each pair of chunks is a group of its own."""
    members = found.where("chunk >= 0").select("chunk", F.col("a").alias("key"), F.col("b").alias("fp"))
    most = members.groupBy("key").agg(F.max("chunk").alias("most"))
    pairs = members.join(most, "key").where("most > 0").select(
        "key", "fp", "chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("most"))).alias("other")).where("chunk <> other")
    keyed = pairs.select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(max_bits, 2 * bucket), "chunk long, a long, b long")


def links(nodes: DataFrame, ws: Workspace, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links ``a, b`` that span the components of the distinct fingerprints in ``nodes.fp``."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the Golay keys cover up to three differing bits")
    keys = nodes.select("fp").mapInArrow(each_batch(_emit_keys), "key long, fp long")
    dealt = keys.repartition("key").sortWithinPartitions("key", "fp")
    found = ws.keep(dealt.mapInArrow(_links(max_bits, bucket), "chunk long, a long, b long"), "links")
    edges = found.where("chunk = -1").select("a", "b")
    if found.where("chunk >= 0").limit(1).count():
        more = ws.keep(_between_chunks(found, max_bits, bucket), "links_between")
        edges = edges.unionByName(more.where("chunk = -1").select("a", "b"))
    return edges


def component_ids(fps: DataFrame, ws: Workspace, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """``fp, component_id, root`` of each distinct fingerprint of ``fps`` (``doc_id, fp``): the smallest id
    reachable, and what names the component even where ids are null or repeated."""
    nodes = ws.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("_first")), "nodes")
    stars = components(links(nodes, ws, max_bits, bucket), ws)
    rooted = ws.keep(nodes.join(stars, nodes.fp == stars.node, "left").select("fp", "_first", F.coalesce("root", "fp").alias("_root")), "rooted")
    first = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    return ws.keep(rooted.join(first, "_root").select("fp", "component_id", F.col("_root").alias("root")), "component_ids")


def near_duplicates(docs: DataFrame, text: str = "text", width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``."""
    ws = Workspace(docs.sparkSession, "simhash")
    fps = ws.keep(fingerprints(docs, text, ["doc_id"], width), "fps")
    ids = component_ids(fps, ws, max_bits, bucket)
    return fps.join(ids, "fp").select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, one of each group of linked documents: the one with the smallest id
    (a null one last, then a hash of the text).  Equal rows are one of them."""
    ws = Workspace(docs.sparkSession, "simhash-keep")
    keyed = docs.select(*row_key("doc_id", text), "doc_id", F.col(text).alias("_text"))
    fps = ws.keep(fingerprints(keyed, "_text", ["_k1", "_k2", "doc_id"], width), "fps")
    ids = component_ids(fps, ws, max_bits)
    order = F.struct(F.col("_k1").isNull().alias("no_id"), "_k1", "_k2")
    kept = fps.join(ids, "fp").groupBy("root").agg(F.min(order).alias("o")).select(F.col("o._k1").alias("_k1"), F.col("o._k2").alias("_k2"))
    times = fps.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_times"))
    kept = ws.keep(kept.join(times, kept._k1.eqNullSafe(times._k1) & (kept._k2 == times._k2)).select(kept._k1, kept._k2, "_times"), "kept")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *row_key("doc_id", text))
    found = rows.join(kept.hint("merge"), rows._k1.eqNullSafe(kept._k1) & (rows._k2 == kept._k2)).select("_row", rows._k1, rows._k2, "_times")
    once = found.where("_times > 1").dropDuplicates(["_k1", "_k2"])
    return found.where("_times = 1").unionByName(once).select("_row.*")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
