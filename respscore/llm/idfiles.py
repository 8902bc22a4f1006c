"""Token ids in bit-packed files (operator 6).

One file (shard) holds the documents of one range of ids, ascending:

    blocks        ids of all documents one after another, ``block_ids`` to a block; each id takes the
                  least bits that hold the vocabulary, most significant bit first; a block starts at a byte
    document ids  int64 each; then one byte each that is 0 for a null id
    token counts  int64 each, the end id included
    block offsets int64 each, one more than blocks: byte offsets from the file's start
    tail          int64: bits, block_ids, documents, ids; then 8 bytes of MAGIC

All integers are little-endian.  Offsets and a fixed width give random access:
``read_ids(file, start, n)`` touches only the blocks that hold the range, and
unpacks them with numpy.

Defined results: a null or empty text is the end id alone; a null id comes
first; equal ids are ordered by a hash of the text, equal rows are written
each; an empty table writes no file; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytebpe import encoder
from .common import Workspace, deal, table, text_slices
from .files import open_read, write_whole

MAGIC = b"IDBITS01"
BLOCK_IDS = 1 << 16
_TAIL = "<4q8s"
_TAIL_BYTES = struct.calcsize(_TAIL)


# ------------------------------------------------------------------ blocks
def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, most significant first, padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits:]
    return np.packbits(each.ravel()).tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids (uint32) of a block."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f">u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits:] = each
    return np.packbits(wide, axis=1).view(">u4").ravel().astype("<u4")


class Shard:
    """Writes one file from runs of documents; holds a block of ids and 17 bytes a document."""

    def __init__(self, f: BinaryIO, bits: int, block_ids: int):
        self.f, self.bits, self.block_ids = f, bits, block_ids
        self.rest, self.waiting = [], 0
        self.docs, self.counts, self.offsets = [], [], [0]

    def add(self, doc_id: int | None, *ids: np.ndarray) -> None:
        """A document, its ids in one or more parts."""
        self.docs.append(doc_id)
        self.counts.append(sum(map(len, ids)))
        self.rest += ids
        self.waiting += self.counts[-1]
        if self.waiting >= 16 * self.block_ids:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for at in range(0, whole, self.block_ids):
            raw = pack(ids[at:min(whole, at + self.block_ids)], self.bits)
            self.f.write(raw)
            self.offsets.append(self.offsets[-1] + len(raw))
        self.rest, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._write(True)
        self.f.write(np.array([x or 0 for x in self.docs], "<i8").tobytes())
        self.f.write(np.array([x is not None for x in self.docs], np.uint8).tobytes())
        self.f.write(np.array(self.counts, "<i8").tobytes())
        self.f.write(np.array(self.offsets, "<i8").tobytes())
        self.f.write(struct.pack(_TAIL, self.bits, self.block_ids, len(self.docs), sum(self.counts), MAGIC))


class ShardReader:
    """Random access to one file."""

    def __init__(self, f: BinaryIO):
        self.f = f
        end = f.seek(0, 2)
        f.seek(end - _TAIL_BYTES)
        self.bits, self.block_ids, n, self.n_ids, magic = struct.unpack(_TAIL, f.read(_TAIL_BYTES))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        blocks = -(-self.n_ids // self.block_ids)
        f.seek(end - _TAIL_BYTES - 8 * (blocks + 1) - 17 * n)
        ids, known = np.frombuffer(f.read(8 * n), "<i8"), np.frombuffer(f.read(n), np.uint8)
        self.docs = [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)]
        self.counts = np.frombuffer(f.read(8 * n), "<i8")
        self.offsets = np.frombuffer(f.read(8 * (blocks + 1)), "<i8")

    def read_ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from the ``start``-th on."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (start + n - 1) // self.block_ids
        self.f.seek(int(self.offsets[first]))
        raw, base = self.f.read(int(self.offsets[last + 1] - self.offsets[first])), int(self.offsets[first])
        out = [unpack(raw[int(self.offsets[b]) - base:int(self.offsets[b + 1]) - base], min(self.block_ids, self.n_ids - b * self.block_ids), self.bits)
               for b in range(first, last + 1)]
        return np.concatenate(out)[start - first * self.block_ids:][:n]

    def documents(self, most: int = 1 << 22) -> Iterator[tuple[int | None, np.ndarray]]:
        """Every document's id and ids, reading about ``most`` ids at a time."""
        ends = np.cumsum(self.counts)
        i, at = 0, 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, at + most, side="right")))
            ids = self.read_ids(at, int(ends[j - 1]) - at)
            for k in range(i, j):
                lo = int(ends[k] - self.counts[k]) - at
                yield self.docs[k], ids[lo:lo + int(self.counts[k])]
            i, at = j, int(ends[j - 1])


# ------------------------------------------------------------------ Spark
def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, text: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the ids of ``docs``, each document followed by ``end_id``, in ascending order of ``doc_id``
    over the files of ``folder``; a lazy ``shard, path, n_docs, n_ids`` per file (keep it as a table).

    One shuffle: texts are dealt by range of their id, so files are in order, and encoded where they
    arrive.  A task that is repeated writes the same bytes and moves the whole file into place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        path, found = f"{folder}/shard-{shard:06d}.ids", []
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        bpe = encoder(tokenizer)
        end = np.array([end_id], np.uint32)

        def write(f: BinaryIO) -> None:
            out = Shard(f, bits_for(max(bpe.vocabulary, end_id + 1)), block_ids)
            b = first
            while b is not None:
                for text, docs_ in text_slices(b, "_text", "doc_id"):
                    ids, n = bpe.encode(text)
                    at = 0
                    for doc, k in zip(docs_.to_pylist(), n.tolist(), strict=True):
                        out.add(doc, ids[at:at + k], end)
                        at += k
                b = next(batches, None)
            out.close()
            found.append((len(out.docs), sum(out.counts)))

        write_whole(path, write)
        n_docs, n_ids = found[0]
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": n_docs, "n_ids": n_ids}],
                                         schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("_text"))
    tie = F.xxhash64(F.coalesce("_text", F.lit("")))
    dealt = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    return dealt.mapInArrow(run, "shard int, path string, n_docs long, n_ids long")


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of ``shards``: a task reads
    whole files, block by block.  Only the counts per file meet in one place."""
    before = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                with open_read(path) as f:
                    shard = ShardReader(f)
                    crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in shard.documents()]
                    starts = base + np.cumsum(shard.counts) - shard.counts
                    yield pa.RecordBatch.from_arrays([pa.array(shard.docs, pa.int64()), pa.array(starts), pa.array(shard.counts), pa.array(crcs, pa.int64())],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    based = shards.select("path", before.alias("base"))
    return deal(based, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packed_ids(spark, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "ids")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = ws.keep(write_ids(docs, f"{ws.path}/files", tokenizer_path(), end_id=0), "shards")
    return read_documents(shards)
