"""Suffix-array dedup (operator 5): remove bytes of strings that also start earlier.

Every byte covered by a ``length``-byte string that starts earlier too
(smaller document id, or the same document further left) is removed.  The
suffixes of the corpus are dealt so that equal strings meet, and each part
sorts its own with the difference-cover algorithm (``dc3``): sampled triples,
names by recursion, merge of the remaining suffixes; then adjacent suffixes
are compared over their first ``length`` bytes.

How suffixes are dealt.  Of all 32-byte substrings of the string at a position,
the one with the least hash (leftmost on ties) is its anchor, so equal strings
have equal anchors at equal distances.  Neighbouring positions mostly share
an anchor, about 35 of them, and travel as one snippet of their bytes.  A
string whose anchor hash occurs once in the corpus can't repeat: the hashes
found twice or more are kept as a table, and only snippets of these go on.  Up
to some 22 million such hashes a Bloom filter of a fixed size holds them (it
lets a few others through and loses none); beyond, runs of positions without
their bytes are semi-joined with the table, and each text cuts its snippets
from the runs that are left.

Equal snippets are folded before they are sorted, first among the rows a task
reads (so a passage that a third of all documents hold is one snippet per
batch) and again where they meet.  Snippets of one anchor whose bytes exceed
``most_bytes`` (passages whose surroundings differ everywhere) don't stay in
one task: the same difference-cover sort runs over them as Spark range sorts,
prefix sums and joins (``dcspark``; with ``most_bytes=0`` over all snippets).

Defined results: a null or empty text, or one shorter than ``length``, stays
as it is; documents are taken in order of id, a null id last, then a hash of
the text; rows equal in id and text are one document; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, row_key, slices, table
from .dc3 import suffix_array
from .dcspark import number, suffix_ranks

LENGTH = 100  # fixed value of the contract
GRAM = 32  # bytes of an anchor
FILTER_BITS = 28  # the filter has 2^28 bits: 32 MB at the driver and in each worker
ANCHOR_BITS = 12  # bits of the filter per anchor that occurs again, at least: one in a hundred others passes
MOST_BYTES = 12 << 20  # snippets of one anchor that a task sorts
SORT_BYTES = 1 << 20  # snippets sorted at once (whole anchors): memory is about 130 times this
SLICE_BYTES = 4 << 20  # text in which a task folds equal snippets
STEP = 1 << 16  # positions hashed at once, so that numpy's passes stay in the cache

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_HASHES = len(_ODD)


# ------------------------------------------------------------------ anchors
def _byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


_VALUES = _byte_values()


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) at each position, by doubling."""
    h, base, size = _VALUES[raw], int(_ODD[2]), 1
    while size < gram:
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base % (1 << 64), 2 * size
    h ^= h >> np.uint64(31)
    h *= _ODD[1]
    h ^= h >> np.uint64(29)
    return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value in each window of ``width``."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[:len(x) - (width - size)], x[width - size:])


def anchors(raw: np.ndarray, ends: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of positions with one anchor: (document, first, last, anchor, hash) arrays, positions in ``raw``.
    ``ends`` are the documents' ends in ``raw``; strings don't cross them."""
    window, sizes = length - gram + 1, np.diff(ends, prepend=0)
    stop = np.repeat(ends, sizes)  # where each position's document ends
    for at in range(0, len(raw) - length + 1, STEP):
        some = raw[at:at + STEP + length - 1]
        h = gram_hashes(some, gram)
        index = np.arange(len(h), dtype=np.uint64)
        anchor = (_least((h & ~np.uint64((1 << 24) - 1)) | index, window) & np.uint64((1 << 24) - 1)).astype(np.int64)
        here = stop[at:at + len(anchor)]
        fits = np.flatnonzero(np.arange(at + length, at + length + len(anchor)) <= here)
        if not len(fits):
            continue
        a, end = anchor[fits], here[fits]
        cut = np.flatnonzero((a[1:] != a[:-1]) | (end[1:] != end[:-1])) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(a)]]) - 1
        yield np.searchsorted(ends, end[first]), fits[first] + at, fits[last] + at, a[first] + at, h[a[first]]


def _texts(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The texts of a batch in slices: bytes, ends of documents in them, and the first row."""
    texts = b.column("_text")
    raw = [t.as_buffer() if t.is_valid else pa.py_buffer(b"") for t in texts.cast(pa.large_binary())]
    for s, e in slices([x.size for x in raw], SLICE_BYTES):
        yield np.frombuffer(b"".join(raw[s:e]), np.uint8), np.cumsum([x.size for x in raw[s:e]]), s


# ------------------------------------------------------------------ anchors that occur again
def _count_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, ends, _ in _texts(b):
                found = [h for *_, h in anchors(raw, ends, length, gram)]
                if found:
                    h, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2))], names=["h", "n"])

    return run


def _bits(h: np.ndarray, bits: int) -> np.ndarray:
    """Places of hashes (uint64) in the filter, one row per hash function."""
    return (h[None, :] * _ODD[:, None]) >> np.uint64(64 - bits)


def _filter(spark: SparkSession, again: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter (2^bits bits as uint64 words) of the hashes in ``again.h``; words are joined on the
    executors, so at most 2^(bits-6) of them come to the driver."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = np.unique(_bits(b.column("h").to_numpy().view(np.uint64), bits).ravel())
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    joined = again.mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[joined.column("word").to_numpy()] = joined.column("mask").to_numpy().view(np.uint64)
    return out


# ------------------------------------------------------------------ snippets
_SNIPPETS = "h long, off int, k1 long, k2 long, first long, last long, snippet binary"
_SNIPPET_TYPES = pa.schema([("h", pa.int64()), ("off", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()),
                            ("last", pa.int64()), ("snippet", pa.binary())])


def _place(k1, k2, first) -> tuple:
    """Order of a snippet in the corpus."""
    return (k1 is None, k1 or 0, k2, first)


def _folded(found: list[list]) -> pa.RecordBatch:
    """Snippets (rows of ``_SNIPPETS``) of one slice: of equal ones the earliest alone keeps its bytes; the others
    are covered whole (no bytes: a span of removed starts)."""
    out, seen = [], {}
    for me in found:
        other = seen.setdefault((me[1], me[6]), me)
        if other is not me:
            if _place(*me[2:5]) < _place(*other[2:5]):
                other[2:6], me[2:6] = me[2:6], other[2:6]
            if _place(*me[2:5]) == _place(*other[2:5]):
                continue
            me[0], me[6] = me[3] ^ me[4], None  # covered: only passed on, to any task
        out.append(me)
    columns = zip(*out, strict=True) if out else [[]] * len(_SNIPPET_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SNIPPET_TYPES, strict=True)], schema=_SNIPPET_TYPES)


def _snippets(length: int, gram: int, bits: int, held):
    """mapInArrow function: the snippets whose anchor passes the filter, equal ones of a slice folded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = held.value
        for b in batches:
            k1s, k2s = b.column("_k1").to_pylist(), b.column("_k2").to_pylist()
            for raw, ends, row in _texts(b):
                starts, whole, out = np.concatenate([[0], ends[:-1]]), raw.tobytes(), []
                for doc, first, last, anchor, h in anchors(raw, ends, length, gram):
                    at = _bits(h, bits)
                    hit = np.flatnonzero(((table_[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0))
                    rel = starts[doc]
                    for d, f, n, off, x, base in zip(doc[hit].tolist(), first[hit].tolist(), last[hit].tolist(), (anchor - first)[hit].tolist(),
                                                     h[hit].view(np.int64).tolist(), rel[hit].tolist(), strict=True):
                        out.append([x, off, k1s[row + d], k2s[row + d], f - base, n - base, whole[f:n + length]])
                yield _folded(out)

    return run


def _anchor_runs(length: int, gram: int):
    """mapInArrow function: every run of positions with one anchor, without its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column("_k1"), b.column("_k2")
            for raw, ends, row in _texts(b):
                starts = np.concatenate([[0], ends[:-1]])
                for doc, first, last, anchor, h in anchors(raw, ends, length, gram):
                    of, base = pa.array(doc + row), starts[doc]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((anchor - first).astype(np.int32)), k1.take(of), k2.take(of),
                                                      pa.array(first - base), pa.array(last - base)], names=["h", "off", "_k1", "_k2", "first", "last"])

    return run


def _snippets_of_runs(length: int):
    """mapInArrow function: the snippets of the runs a text is joined with (``_runs``), equal ones of a slice folded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = [len(t.as_buffer()) if t.is_valid else 0 for t in b.column("_text")]
            for s, e in slices(size, SLICE_BYTES):
                out = []
                for k1, k2, t, runs in zip(b.column("_k1")[s:e].to_pylist(), b.column("_k2")[s:e].to_pylist(), b.column("_text")[s:e],
                                           b.column("_runs")[s:e], strict=True):
                    raw = t.as_buffer()
                    for r in runs.as_py():
                        out.append([r["h"], r["off"], k1, k2, r["first"], r["last"], bytes(raw[r["first"]:r["last"] + length])])
                yield _folded(out)

    return run


def _joined_snippets(rows: DataFrame, again: DataFrame, length: int) -> DataFrame:
    """The snippets whose anchor is in ``again``, by joins: for as many anchors as there may be."""
    runs = rows.mapInArrow(_anchor_runs(length, GRAM), "h long, off int, _k1 long, _k2 long, first long, last long")
    lists = runs.join(again, "h", "left_semi").groupBy("_k1", "_k2").agg(F.collect_set(F.struct("h", "off", "first", "last")).alias("_runs"))
    r, x = rows.alias("r"), lists.alias("x").hint("merge")
    one = r.join(x, F.col("r._k1").eqNullSafe(F.col("x._k1")) & (F.col("r._k2") == F.col("x._k2")))
    return one.select("r._k1", "r._k2", "r._text", "x._runs").mapInArrow(_snippets_of_runs(length), _SNIPPETS)


def repeated_starts(snippets: list[bytes], order: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """For each snippet, the offsets whose ``length``-byte string also starts earlier (``order`` ranks the
    snippets' documents, ``at`` are their places in them; repeated rows may give overlapping snippets of one document)."""
    sizes = np.array([len(x) for x in snippets])
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    s = np.frombuffer(b"".join(x + b"\0" for x in snippets), np.uint8).astype(np.int64) + 2
    s[ends - 1] = 1  # below all bytes, at the end of each snippet
    sa = suffix_array(s, 257)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    sa = sa[sa + length <= ends[owner[sa]] - 1]
    padded = np.concatenate([s - 2, np.zeros(8, np.int64)]).astype(np.uint8)
    eight = np.lib.stride_tricks.as_strided(padded, (len(s), 8), (1, 1))
    eight = np.ascontiguousarray(eight).view(np.uint64).ravel()
    same = np.ones(max(0, len(sa) - 1), bool)
    for x in [*range(0, length - 7, 8), length - 8]:  # adjacent prefixes, eight bytes at a time
        k = np.flatnonzero(same)
        same[k] = eight[sa[k] + x] == eight[sa[k + 1] + x]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(sa) else np.zeros(0, np.int64)
    of, off = owner[sa], sa - begins[owner[sa]]
    by = np.lexsort((at[of] + off, order[of], group))
    g, o, f = group[by], order[of][by], (at[of] + off)[by]
    head = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(head, np.arange(len(g)), 0)) if len(g) else np.zeros(0, np.int64)
    later = by[(o > o[lead]) | (f > f[lead])] if len(g) else by
    out, mine, offs = [np.zeros(0, np.int64)] * len(snippets), of[later], off[later]
    by = np.lexsort((offs, mine))
    mine, offs = mine[by], offs[by]
    for i, part in zip(*np.unique(mine, return_index=True), strict=True):
        out[i] = offs[part:np.searchsorted(mine, i, side="right")]
    return out


def _within(snippet: bytes, length: int) -> bool:
    """Whether a string may occur twice inside a snippet: all its strings share some bytes, which would then recur."""
    most = len(snippet) - length  # starts
    return most > 0 and snippet.find(snippet[most:length], most + 1) >= 0


def _sort_group(rows: list[tuple], length: int) -> Iterator[tuple]:
    """Removed starts (k1, k2, first, last) among snippets of whole anchors."""
    folded: dict[tuple, tuple] = {}
    for r in rows:
        key = (r[0], r[1], r[6])
        kept = folded.get(key)
        if kept is None:
            folded[key] = r
            continue
        early, late = (r, kept) if _place(*r[2:5]) < _place(*kept[2:5]) else (kept, r)
        folded[key] = early
        if _place(*early[2:5]) < _place(*late[2:5]):
            yield late[2], late[3], late[4], late[5]
    alone = Counter(r[0] for r in folded.values())
    rows = [r for r in folded.values() if alone[r[0]] > 1 or _within(r[6], length)]  # the only one of its anchor repeats within itself or not at all
    if not rows:
        return
    of = [_place(r[2], r[3], 0) for r in rows]
    rank = {p: i for i, p in enumerate(sorted(set(of)))}
    order, at = np.array([rank[p] for p in of]), np.array([r[4] for r in rows])
    for r, offs in zip(rows, repeated_starts([r[6] for r in rows], order, at, length), strict=True):
        if len(offs):
            cut = np.flatnonzero(np.diff(offs) != 1) + 1
            for a, z in zip(offs[np.concatenate([[0], cut])].tolist(), offs[np.concatenate([cut, [len(offs)]]) - 1].tolist(), strict=True):
                yield r[2], r[3], r[4] + a, r[4] + z


def _sort_snippets(length: int, most_bytes: int, sort_bytes: int):
    """mapInArrow function over snippets sorted by anchor hash: removed starts, and, without bytes bound to a
    task, the snippets of anchors above ``most_bytes`` as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, size = [], 0  # whole anchors
        group, bytes_, wide, key = [], 0, False, None

        def spans(rows) -> Iterator[pa.RecordBatch]:
            found = [(None, None, k1, k2, f, n, None) for k1, k2, f, n in rows]
            if found:
                yield batch(found)

        def batch(rows) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SNIPPET_TYPES, strict=True)], schema=_SNIPPET_TYPES)

        for b in batches:
            covered = b.column("snippet").is_null()
            if covered.true_count:
                yield b.filter(covered)
                b = b.filter(pc.invert(covered))
            for r in zip(*(b.column(f.name).to_pylist() for f in _SNIPPET_TYPES), strict=True):
                if r[0] != key:
                    if not wide:
                        ready += group
                        size += bytes_
                    elif group:
                        yield batch(group)
                    if size >= sort_bytes:
                        yield from spans(_sort_group(ready, length))
                        ready, size = [], 0
                    group, bytes_, wide, key = [], 0, False, r[0]
                group.append(r)
                bytes_ += len(r[6])
                if bytes_ > most_bytes or (wide and bytes_ > sort_bytes):
                    yield batch(group)
                    group, bytes_, wide = [], 0, True
        if wide and group:
            yield batch(group)
        elif not wide:
            ready += group
        yield from spans(_sort_group(ready, length))

    return run


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Snippets as rows of symbols."""
    for b in batches:
        raw = b.column("snippet").to_pylist()
        for a, z in slices([len(x) for x in raw], SORT_BYTES):
            sizes = np.array([len(x) for x in raw[a:z]])
            s = np.repeat(b.column("s").to_numpy()[a:z], sizes)
            i = np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            c = np.frombuffer(b"".join(raw[a:z]), np.uint8).astype(np.int64) + 1
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(i.astype(np.int32)), pa.array(c)], names=["s", "i", "c"])


def _wide(found: DataFrame, ws: Workspace, length: int) -> DataFrame:
    """Removed starts of the snippets whose anchors were too many for a task: the same sort over tables
    (``dcspark``), then adjacent strings compared across the borders of parts too."""
    place = F.struct(F.col("k1").isNull().alias("n"), "k1", "k2", "first")
    rows = found.where("snippet IS NOT NULL").select("off", "k1", "k2", "first", "last", "snippet", place.alias("place"))
    kept = ws.keep(rows.groupBy("off", "snippet").agg(F.min("place").alias("p"))  # equal ones are sorted once
                   .select(F.monotonically_increasing_id().alias("s"), "off", "snippet", "p"), "wide")
    copies = rows.join(kept, ["off", "snippet"]).where(F.col("place") > F.col("p")).select("k1", "k2", "first", "last")

    ranks = suffix_ranks(ws.keep(kept.mapInArrow(_symbols, "s long, i int, c long"), "symbols"), length, ws)
    starts = ranks.join(kept.select("s", "snippet", "p"), "s").where(F.col("i") + length <= F.length("snippet"))
    starts = starts.select("s", "i", "r", "p", F.substring("snippet", F.col("i") + 1, F.lit(length)).alias("string"), F.lit(False).alias("_zero"))
    adjacent, _ = number(starts, ["r"], ["string"], ws, "adjacent")
    at = F.struct("p.n", "p.k1", "p.k2", (F.col("p.first") + F.col("i")).alias("at"))
    each = adjacent.select("before", at.alias("at"))
    first = each.groupBy("before").agg(F.min("at").alias("_first"))
    later = each.join(first, "before").where(F.col("at") > F.col("_first"))
    return later.select("at.k1", "at.k2", F.col("at.at").alias("first"), F.col("at.at").alias("last")).unionByName(copies)


# ------------------------------------------------------------------ removal
def removed_starts(docs: DataFrame, ws: Workspace, text: str = "text", length: int = LENGTH, filter_bits: int = FILTER_BITS,
                   most_bytes: int = MOST_BYTES, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """``k1, k2, first, last``: runs of byte positions whose ``length``-byte string also starts earlier."""
    if not GRAM + 8 <= length < 1 << 16:
        raise ValueError(f"strings of {GRAM + 8} to 65,535 bytes")
    spark = docs.sparkSession
    rows = docs.select(*row_key("doc_id", text), F.col(text).alias("_text"))
    counted = rows.select("_text").mapInArrow(_count_anchors(length, GRAM), "h long, n long")
    again = ws.keep(counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "again")
    if again.count() * ANCHOR_BITS <= 1 << filter_bits:
        some = rows.mapInArrow(_snippets(length, GRAM, filter_bits, spark.sparkContext.broadcast(_filter(spark, again, filter_bits))), _SNIPPETS)
    else:
        some = _joined_snippets(rows, again, length)
    dealt = some.repartition("h").sortWithinPartitions("h")
    found = ws.keep(dealt.mapInArrow(_sort_snippets(length, most_bytes, sort_bytes), _SNIPPETS), "found")
    ws.drop("again")
    spans = found.where("snippet IS NULL").select("k1", "k2", "first", "last")
    if found.where("snippet IS NOT NULL").limit(1).count():
        spans = spans.unionByName(_wide(found, ws, length))
    return spans


def _cut(length: int):
    """mapInArrow function: what is left of each text."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = [len(t.as_buffer()) if t.is_valid else 0 for t in b.column("_text")]
            for s, e in slices(size, SLICE_BYTES):
                out = []
                for doc, t, spans in zip(b.column("_k1")[s:e].to_pylist(), b.column("_text")[s:e], b.column("_spans")[s:e].to_pylist(), strict=True):
                    raw = (t.as_py() or "").encode()
                    runs = []
                    for first, last in sorted((x >> 16, (x >> 16) + (x & 65535) + length) for x in spans or ()):
                        if runs and first <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], last)
                        else:
                            runs.append([first, last])
                    keep, at = [], 0
                    for first, last in runs:
                        keep.append(raw[at:first])
                        at = last
                    kept = b"".join([*keep, raw[at:]])
                    out.append((doc, len(raw), len(raw) - len(kept), len(runs), kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    return run


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, filter_bits: int = FILTER_BITS,
                   most_bytes: int = MOST_BYTES, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row of ``docs``; ``kept`` are the bytes left."""
    ws = Workspace(docs.sparkSession, "suffix")
    spans = removed_starts(docs, ws, text, length, filter_bits, most_bytes, sort_bytes)
    packed = F.shiftleft("first", 16).bitwiseOR(F.col("last") - F.col("first"))  # a run is shorter than a string
    lists = ws.keep(spans.groupBy("k1", "k2").agg(F.collect_set(packed).alias("_spans")), "spans")
    rows = docs.select(*row_key("doc_id", text), F.col(text).alias("_text"))
    both = rows.join(lists.hint("merge"), rows["_k1"].eqNullSafe(lists["k1"]) & (rows["_k2"] == lists["k2"]), "left").select("_k1", "_text", "_spans")
    return both.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_array(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
