"""Cross-tokenizer alignment (operator 12) by interval coalescing.

Tokens of two tokenizers, A and B, are byte intervals over the same text.  All
of them are lexsorted by start, the ends are accumulated to a running maximum,
and a group breaks where a start reaches it: there A and B both end a token.
Within a group every A token overlaps or neighbours every B token; these are
its links.  ``align`` does this for slices of many texts at once, whose bytes
stand one after another, and keeps per document its distinct linked id pairs
with their number; links of a large group are counted by its distinct ids, so
no group is expanded to all its pairs of occurrences.

``link_counts`` counts over the corpus how many documents hold a pair linked.
The pairs of the highest counts, at most ``head_rows`` of them, are broadcast
back to the documents; the others, each held by fewer documents than any of
those, join by shuffle.  Hot pairs so never meet in one task.

Defined results: a null or empty text, and one whose bytes A or B does not give
back, has no tokens (zeros, an empty digest) and counts for no pair; repeated
rows are documents of their own; an empty table gives an empty result; other
columns are carried only where named.  One document's tokens must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytebpe import ByteBpe
from .common import Workspace, slices, table
from .piecebpe import PieceBpe, model_path
from .process import kept
from .words import gather

SLICE_BYTES = 2 << 20  # text that a task aligns at once
A_WORDS = 300_000      # words that A keeps in a worker, beside those of B
DIRECT = 64            # links of a group that are listed one by one
HEAD_ROWS = 500_000    # pairs that are broadcast


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for
    themselves, all other bytes in order for the characters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(others)}}


class _Bytes:
    """What each id of a vocabulary stands for, as bytes one after another."""

    def __init__(self, of_id: list[bytes]):
        self.data = np.frombuffer(b"".join(of_id), np.uint8)
        self.n = np.array([len(x) for x in of_id], np.int64)
        self.ends = np.cumsum(self.n)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.data, self.ends, ids)[0]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def coalesce(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B interval: sorted by start, a group breaks where a start reaches
    the running maximum of the ends before it."""
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    side = np.repeat(np.array([0, 1], np.int8), [len(start_a), len(start_b)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(order), np.int64)
    group[order] = np.concatenate([np.zeros(min(len(order), 1), np.int64), np.cumsum(start[order][1:] >= reach[:-1])])
    return group[:len(start_a)], group[len(start_a):]


class Aligner:
    """Aligns texts under one pair of vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteBpe(path_a, ordinary=True, most=A_WORDS), PieceBpe(path_b)
        alphabet, entries = byte_alphabet(), self.a.tokenizer.get_vocab()
        of_id = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            of_id[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.bytes_a, self.bytes_b = _Bytes(of_id), _Bytes(self.b.surface)
        self.width = len(self.b.surface)  # a pair's code is a * width + b
        most = max(len(of_id), self.width)
        digits = [str(i).encode() for i in range(most)]
        self.wide = len(digits[-1]) + 1
        self.digits = np.frombuffer(b"".join(d.ljust(self.wide) for d in digits), np.uint8).reshape(most, self.wide)
        self.n_digits = np.array([len(d) for d in digits], np.int64)

    def _same(self, texts: pa.Array, sizes: np.ndarray, ids: np.ndarray, n: np.ndarray, table: _Bytes) -> np.ndarray:
        """Whether the tokens of each text give back its bytes."""
        bounds = np.concatenate([[0], np.cumsum(n)])
        ok = _sums(table.n[ids], bounds) == sizes
        few = texts.filter(pa.array(ok))
        offsets = np.frombuffer(few.buffers()[1], np.int32, len(few) + 1, 4 * few.offset)
        want = np.frombuffer(few.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        wrong = np.flatnonzero(table(ids[np.repeat(ok, n)]) != want)
        ok[np.flatnonzero(ok)[np.unique(np.searchsorted(offsets - offsets[0], wrong, side="right") - 1)]] = False
        return ok

    def __call__(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Tokens and groups of texts: ids, their number per text, each token's group and each group's text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        sizes = pc.binary_length(spaced).to_numpy().astype(np.int64)
        (ids_a, n_a), (ids_b, n_b) = self.a.encode(spaced), self.b.encode(texts)
        ids_a, ids_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
        ok = self._same(spaced, sizes, ids_a, n_a, self.bytes_a) & self._same(spaced, sizes, ids_b, n_b, self.bytes_b)
        if not ok.all():
            ids_a, ids_b, n_a, n_b = ids_a[np.repeat(ok, n_a)], ids_b[np.repeat(ok, n_b)], np.where(ok, n_a, 0), np.where(ok, n_b, 0)
        end_a, end_b = np.cumsum(self.bytes_a.n[ids_a]), np.cumsum(self.bytes_b.n[ids_b])
        in_a, in_b = coalesce(end_a - self.bytes_a.n[ids_a], end_a, end_b - self.bytes_b.n[ids_b], end_b)
        count_a, count_b = np.bincount(in_a), np.bincount(in_b)
        first_a = np.cumsum(count_a) - count_a
        text_of = np.repeat(np.arange(len(texts)), n_a)[first_a] if len(first_a) else np.zeros(0, np.int64)
        return {"a": ids_a, "b": ids_b, "n_a": n_a, "n_b": n_b, "in_a": in_a, "in_b": in_b, "count_a": count_a, "count_b": count_b, "text": text_of}

    def digests(self, x: dict[str, np.ndarray]) -> list[str]:
        """SHA-256 of each text's groups, written as ``a1,a2|b1;a3|b2,b3``; without tokens an empty string."""
        total_a, total_b = np.cumsum(x["count_a"]), np.cumsum(x["count_b"])
        place_a = np.arange(len(x["a"])) + (total_b - x["count_b"])[x["in_a"]]
        place_b = np.arange(len(x["b"])) + total_a[x["in_b"]]
        ids, marks = np.empty(len(place_a) + len(place_b), np.int64), np.full(len(place_a) + len(place_b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = x["a"], x["b"]
        marks[place_a[total_a - 1]], marks[place_b[total_b - 1]] = ord("|"), ord(";")
        written, n = self.digits[ids], self.n_digits[ids]
        written[np.arange(len(ids)), n] = marks
        flat = written[np.arange(self.wide) <= n[:, None]]
        ends = np.concatenate([[0], np.cumsum(n + 1)])[np.cumsum(x["n_a"] + x["n_b"])]
        out, start = [], 0
        for end in ends.tolist():
            out.append(hashlib.sha256(flat[start:end - 1].data).hexdigest() if end > start else "")
            start = end
        return out

    def pairs(self, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, code, links) of the distinct linked pairs of each text, in order."""
        each = x["count_a"] * x["count_b"]
        span = len(self.bytes_a.n) * self.width
        first_b = np.cumsum(x["count_b"]) - x["count_b"]
        small = each[x["in_a"]] <= DIRECT
        group = x["in_a"][small]
        times = x["count_b"][group]
        upto = np.cumsum(times)
        b_at = np.repeat(first_b[group] - (upto - times), times) + np.arange(upto[-1] if len(upto) else 0)
        codes = np.repeat(x["text"][group] * span + x["a"][small] * self.width, times) + x["b"][b_at]
        codes, n = np.unique(codes, return_counts=True)
        large = np.flatnonzero(each > DIRECT)
        if len(large):
            first_a, more, more_n = np.cumsum(x["count_a"]) - x["count_a"], [codes], [n]
            for g in large.tolist():
                a, na = np.unique(x["a"][first_a[g]:first_a[g] + x["count_a"][g]], return_counts=True)
                b, nb = np.unique(x["b"][first_b[g]:first_b[g] + x["count_b"][g]], return_counts=True)
                more.append((x["text"][g] * span + a[:, None] * self.width + b).ravel())
                more_n.append(np.outer(na, nb).ravel())
            codes, n = np.concatenate(more), np.concatenate(more_n)
            order = np.argsort(codes, kind="stable")
            codes, n = codes[order], n[order]
            heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            codes, n = codes[heads], np.add.reduceat(n, heads)
        return codes // span, codes % span, n


def aligner(path_a: str, path_b: str) -> Aligner:
    return kept(("align", path_a, path_b), lambda: Aligner(path_a, path_b))


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", carry: Sequence[str] = ("doc_id",), groups: bool = False) -> DataFrame:
    """The ``carry`` columns of ``docs`` beside ``n_a, n_b, n_groups, n_links, groups_sha256`` and ``links``, an
    array of structs (``pair``: a * size of B + b, ``times``: how many links of the text are this pair).
    With ``groups`` also ``a_ids, b_ids`` and ``a_in_group, b_in_group``, how many tokens each group has."""
    names = list(carry)
    more = ["a_ids", "b_ids", "a_in_group", "b_in_group"] if groups else []

    def lists(values: pa.Array, bounds: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = aligner(path_a, path_b)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_pylist()
            for start, end in slices(sizes, SLICE_BYTES):
                part = batch.slice(start, end - start)
                x, rows = match(part.column("_text")), end - start
                bounds = np.searchsorted(x["text"], np.arange(rows + 1))
                of, code, n = match.pairs(x)
                made = [pa.array(x["n_a"]), pa.array(x["n_b"]), pa.array(np.diff(bounds)), pa.array(_sums(x["count_a"] * x["count_b"], bounds)),
                        pa.array(match.digests(x), pa.string()),
                        lists(pa.StructArray.from_arrays([pa.array(code), pa.array(n)], ["pair", "times"]), np.searchsorted(of, np.arange(rows + 1)))]
                if groups:
                    made += [lists(pa.array(x[k].astype(np.int32)), np.concatenate([[0], np.cumsum(x[c])])) for k, c in (("a", "n_a"), ("b", "n_b"))]
                    made += [lists(pa.array(x[k].astype(np.int32)), bounds) for k in ("count_a", "count_b")]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *made], names=[*names, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", *more])

    rows = docs.select(*names, F.col(text).alias("_text"))
    kinds = ["n_a long", "n_b long", "n_groups long", "n_links long", "groups_sha256 string", "links array<struct<pair:bigint,times:bigint>>"]
    schema = T.StructType([f for f in rows.schema if f.name != "_text"] + T._parse_datatype_string(", ".join(kinds + [f"{c} array<int>" for c in more])).fields)
    return rows.mapInArrow(run, schema)


def link_counts(aligned: DataFrame, ws: Workspace, width: int) -> DataFrame:
    """``pair, n, best`` of every linked pair: how many documents hold it, and whether that is the most
    among the pairs of its A id.  Counted in each task first; the most per A id is one row per entry of A."""
    counts = ws.keep(aligned.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "counts")
    of_a = F.floor(F.col("pair") / F.lit(width)).alias("_a")
    most = counts.groupBy(of_a).agg(F.max("n").alias("_most"))
    return ws.keep(counts.withColumn("_a", of_a).join(F.broadcast(most), "_a").select("pair", "n", (F.col("n") == F.col("_most")).alias("best")), "scored")


def head_bound(scored: DataFrame, head_rows: int) -> int:
    """The least power of two such that at most ``head_rows`` pairs have that count or more."""
    bits = scored.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)).alias("rows")).collect()  # 63 rows at most
    total, bound = 0, 64
    for r in sorted(bits, key=lambda r: -r["bits"]):
        total += r["rows"]
        if total > head_rows:
            break
        bound = r["bits"] - 1
    return 1 << min(bound, 62)


def corpus_links(docs: DataFrame, path_a: str, path_b: str, text: str = "text", carry: Sequence[str] = ("doc_id",), head_rows: int = HEAD_ROWS) -> DataFrame:
    """``align`` without its links, with ``n_best`` (links whose pair is the commonest of its A id) and
    ``count_sum`` (the pairs' counts, summed over the links)."""
    ws = Workspace(docs.sparkSession, "align")
    width = len(PieceBpe(path_b).surface)
    aligned = ws.keep(align(docs, path_a, path_b, text, carry).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    scored = link_counts(aligned, ws, width)
    bound = head_bound(scored, head_rows)
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    each = aligned.select("_row", F.inline("links"))
    both = each.join(F.broadcast(scored.where(F.col("n") >= bound)), "pair", "left")
    head = both.where("n IS NOT NULL").groupBy("_row").agg(*sums)
    rest = both.where("n IS NULL").select("_row", "pair", "times").join(scored.where(F.col("n") < bound).hint("merge"), "pair").groupBy("_row").agg(*sums)
    total = head.unionByName(rest).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = aligned.drop("links").join(total, "_row", "left").drop("_row")
    return out.fillna(0, ["n_best", "count_sum"])


def byte_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    out = corpus_links(table(spark, sf_dir, "documents"), byte_path(), model_path())
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
