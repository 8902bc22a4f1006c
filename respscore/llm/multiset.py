"""Homomorphic multiset fingerprints of documents (operator 3).

A document is the multiset of its paragraphs (lines that hold a visible
character).  A paragraph's vector has 256 lanes: BLAKE2b gives the paragraph,
and each of its sentences, a sign per lane, and these are added.  The
fingerprint is the sum of all paragraphs' vectors modulo 2^32, which the text
of one row can't exceed (it has at most one sign a byte, so less than 2^31).
So order does not count; equal multisets have equal fingerprints; a paragraph
is inserted or deleted by adding or subtracting its vector; and two parts of a
document can be summed apart.  Lanes of the sum of n signs spread by the root
of n, so the cosine of two fingerprints estimates which share of their
paragraphs and sentences two documents have in common (error about 1/16).

Defined results: a null or empty text, or one of blank lines, has the zero
fingerprint; two zero fingerprints are alike (1), a zero and another are not
(0); repeated rows have equal fingerprints; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, table

LANES = 256
_MANY = 1 << 14  # sign vectors summed at once
_SENTENCES = re.compile(r"(?<=[.!?])\s+")


def paragraphs(text: str) -> list[str]:
    return [p for p in text.split("\n") if p and not p.isspace()]


def total(parts: Iterable[str]) -> np.ndarray:
    """Sum of the vectors of paragraphs: uint32 lanes, modulo 2^32."""
    parts, size, out = list(parts), LANES // 8, np.zeros(LANES, np.uint32)
    signs = [hashlib.blake2b(p.encode(), digest_size=size, person=b"paragraph").digest() for p in parts]
    signs += [hashlib.blake2b(x.encode(), digest_size=size, person=b"sentence").digest() for p in parts for x in _SENTENCES.split(p)]
    for at in range(0, len(signs), _MANY):
        some = signs[at:at + _MANY]
        raw = b"".join(some)
        ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(some), -1), axis=1).sum(axis=0, dtype=np.int64)
        out += (2 * ones - len(some)).astype(np.uint32)
    return out


def insert(fingerprint: np.ndarray, parts: Iterable[str]) -> np.ndarray:
    return fingerprint + total(parts)


def delete(fingerprint: np.ndarray, parts: Iterable[str]) -> np.ndarray:
    return fingerprint - total(parts)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: 1 if equal, else the cosine of the lanes read as signed numbers."""
    if (a == b).all():
        return 1.0
    x, y = (v.view(f"i{v.itemsize}").astype(np.float64) for v in (a, b))
    norm = np.sqrt((x @ x) * (y @ y))
    return float(min(max(x @ y / norm, 0.0), np.nextafter(1.0, 0))) if norm else 0.0


def edited(text: str, after: str) -> str:
    """The text with its last half (code points, rounded down) replaced by as many of the next document, or all."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def edit(fingerprint: np.ndarray, text: str, changed: str) -> np.ndarray:
    """The fingerprint after an edit: paragraphs of the common beginning stay, the others leave and enter."""
    old, new = paragraphs(text), paragraphs(changed)
    same = next((i for i, (a, b) in enumerate(zip(old, new, strict=False)) if a != b), min(len(old), len(new)))
    return insert(delete(fingerprint, old[same:]), new[same:])


def fingerprints(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (default ``doc_id``) and ``fingerprint`` (lanes as little-endian bytes).  No shuffle."""
    narrow = docs.select(*(carry or ["doc_id"]), F.col(text).alias("_text"))
    names = [c for c in narrow.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [total(paragraphs(t.as_py() or "")).tobytes() for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(fps, pa.binary())], names=[*names, "fingerprint"])

    return narrow.mapInArrow(run, narrow.drop("_text").schema.add("fingerprint", "binary"))


def id_ranges(cuts: list[int], parts: int, rows: int, ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cuts upwards, each range's first part, parts of each range), ranges numbered downwards, the last for
    rows without an id.  ``cuts`` are quantiles of the ids: one that is found several times stands for
    as many parts of rows of that very id, which then makes up a range of its own."""
    times: dict[int, int] = {}
    for c in cuts:
        times[c] = times.get(c, 0) + 1
    hot = {c for c, n in times.items() if n > 1}
    upward = np.array(sorted(set(times) | {c - 1 for c in hot if c > -(1 << 63)}) if parts > 1 else [], dtype=np.int64)
    downward = upward[::-1].tolist()
    width = [1] + [times[c] if c in hot else 1 for c in downward]  # range k > 0 begins, from above, with its cut
    width.append(max(1, -(-parts * (rows - ids) // max(1, rows))))
    first = np.cumsum([0, *width[:-1]])
    return upward, first.astype(np.int64), np.array(width, np.int64)


def with_next(docs: DataFrame, ws: Workspace, text: str = "text") -> DataFrame:
    """Rows of ``docs`` dealt by range of (``doc_id``, hash of the text) and sorted downwards, each part closed by
    a copy of the row that comes after it: columns ``part, doc_id, text, peek`` (``peek`` marks the copy).

    The ranges come from the ids alone.  An id that fills several of them, and rows without an id, are
    split further by the hash, so no part is much larger than others.  The row after a part is the first
    of the next part that is not empty, or the very first, so only one row a part is copied."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("_id"))
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = ids.agg(F.percentile_approx("_id", [k / parts for k in range(1, parts)] or [0.5], 10000).alias("c"),
                    F.count(F.lit(1)).alias("rows"), F.count("_id").alias("ids")).first()
    upward, first, width = id_ranges(found["c"] or [], parts, found["rows"], found["ids"])
    count = int(first[-1] + width[-1])

    @F.pandas_udf("int")
    def place(ids: pd.Series, none: pd.Series, ties: pd.Series) -> pd.Series:
        at = np.where(none.to_numpy(), len(first) - 1, len(upward) - np.searchsorted(upward, ids.to_numpy(), side="left"))
        share = (ties.to_numpy().astype(np.float64) + 2.0 ** 63) / 2.0 ** 64  # 0 to 1, in the order of the hash
        return pd.Series(first[at] + np.minimum((share * width[at]).astype(np.int64), width[at] - 1))

    tie = F.xxhash64(F.coalesce(F.col("_text"), F.lit("")))
    part = place(F.coalesce("_id", F.lit(0)), F.col("_id").isNull(), tie)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col(text).alias("_text")).select(part.alias("part"), "_id", "_text")
    heads = ws.keep(rows.groupBy("part").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), (-F.col("_id")).alias("d"), tie.alias("t"))).alias("h")), "heads")
    order = Window.orderBy("part")  # one row a part
    sent = heads.select((F.lag("part").over(order)).alias("_before"), F.max("part").over(Window.partitionBy()).alias("_last"), "h")
    sent = sent.select(F.coalesce("_before", "_last").alias("_to"), F.col("h.n").alias("_n"), F.col("h.d").alias("_d"), F.col("h.t").alias("_t"))
    same = (rows["_id"].eqNullSafe(-F.col("_d"))) & (tie == F.col("_t"))
    copies = rows.join(F.broadcast(sent), same).dropDuplicates(["_to"]).select(F.col("_to").alias("part"), "_id", "_text", F.lit(True).alias("peek"))
    every = rows.withColumn("peek", F.lit(False)).unionByName(copies)
    return every.repartitionById(count, F.col("part")).sortWithinPartitions("part", "peek", F.desc_nulls_last("_id"), tie)


def edits(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next`` against its edited text and the next document in descending order of ``doc_id``.
    One shuffle of the texts; a task holds two documents."""
    ws = Workspace(docs.sparkSession, "edits")
    kind = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                      ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out = []
            for part, i, t, peek in zip(b.column("part").to_pylist(), b.column("_id").to_pylist(), b.column("_text"), b.column("peek").to_pylist(), strict=True):
                t = t.as_py() or ""
                mark = total(paragraphs(t))
                if held and held[0] == part:
                    _, doc, mine, own = held
                    changed = edited(mine, t)
                    after = edit(own, mine, changed)
                    out.append((doc, len(mine), hashlib.sha256(changed.encode()).hexdigest(), own.tobytes().hex(), after.tobytes().hex(),
                                likeness(own, after), likeness(own, mark)))
                held = None if peek else (part, i, t, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, ws, text).mapInArrow(run, schema)


def op3_multiset_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
