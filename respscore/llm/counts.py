"""Token counts by a separator scan (operator 2).

Flat token files hold nothing but ids (little-endian, of one width), each
document followed by a separator id; there is no index.  ``count_tokens``
cuts such files into blocks without regard to documents, finds the separators
of a block with one numpy comparison, and reports for each block how many ids
stand before its first separator, between separators and after the last.  What
is found is kept as a table.  A prefix scan over four numbers per block then
joins the document that crosses a border and numbers the documents: first over
the ``SUPER`` blocks of a stretch, then over a file's stretches, so no task holds
a long file's blocks, and the counts between separators stay out of it.

Defined results: a null or empty text is a document of no tokens (its
separator alone); ids behind a file's last separator are a document that has
not ended (``ended`` false); an empty file or table gives no rows; repeated
rows are counted each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytebpe import encoder
from .common import Workspace, deal, table, text_slices
from .files import open_read, write_whole

SEPARATOR = 50256  # <|endoftext|> of the vocabulary
BLOCK_BYTES = 4 << 20
SUPER = 4096  # blocks whose numbers are scanned together


def width_for(vocabulary: int) -> int:
    """Bytes to an id."""
    return 2 if vocabulary <= 1 << 16 else 4


def write_flat(docs: DataFrame, folder: str, tokenizer: str, separator: int = SEPARATOR, text: str = "text") -> DataFrame:
    """Encode texts (special strings read as ordinary text) into flat files, one per task, no shuffle.
    Lazily ``file, place, doc_id`` per document; keep it as a table, which writes the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids = f"part-{TaskContext.get().partitionId():06d}.tokens", []
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        bpe = encoder(tokenizer, True)
        kind = f"<u{width_for(max(bpe.vocabulary, separator + 1))}"

        def write(f: BinaryIO) -> None:
            b = first
            while b is not None:
                ids.append(b.column("doc_id"))
                for text, _ in text_slices(b, "_text", "doc_id"):
                    each, n = bpe.encode(text)
                    f.write(np.insert(each.astype(kind), np.cumsum(n), separator).tobytes())
                b = next(batches, None)

        write_whole(f"{folder}/{name}", write)
        at = 0
        for x in ids:
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array(np.arange(at, at + len(x))), x], names=["file", "place", "doc_id"])
            at += len(x)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "file string, place long, doc_id long")


def flat_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, bytes`` of the token files of a folder (listed by Spark, not read)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder)
    return files.select("path", F.col("length").alias("bytes"))


def scan_blocks(files: DataFrame, width: int, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block: ``path, block, ids, seps, head, tail, inner`` (see the module)."""
    step = block_bytes // width * width
    blocks = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(step).cast("bigint"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, at in zip(b.column("path").to_pylist(), b.column("at").to_pylist(), strict=True):
                with open_read(path) as f:
                    f.seek(at)
                    ids = np.frombuffer(f.read(step), f"<u{width}")
                seps = np.flatnonzero(ids == separator)
                n = len(ids)
                out.append({"path": path, "block": at // step, "ids": n, "seps": len(seps), "head": int(seps[0]) if len(seps) else n,
                            "tail": n - 1 - int(seps[-1]) if len(seps) else n, "inner": (np.diff(seps) - 1).tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("block", pa.int64()), ("ids", pa.int64()), ("seps", pa.int64()),
                                                                    ("head", pa.int64()), ("tail", pa.int64()), ("inner", pa.list_(pa.int64()))]))

    return deal(blocks, "path", "at").mapInArrow(run, "path string, block long, ids long, seps long, head long, tail long, inner array<long>")


def count_tokens(files: DataFrame, width: int, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, place, n_tokens, ended`` of every document in flat files (``path, bytes``)."""
    ws = Workspace(files.sparkSession, "scan")
    blocks = ws.keep(scan_blocks(files, width, separator, block_bytes), "blocks")
    kept = blocks.select("path", "block", "head", "inner")
    placed = kept.join(block_places(blocks), ["path", "block"])
    lengths = F.when(F.col("seps") > 0, F.concat(F.array(F.col("begun") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    rest = F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("begun") + F.col("tail"))
    open_ = F.when(F.col("final") & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<bigint>"))
    each = placed.select("path", "place", "seps", F.posexplode(F.concat(lengths, open_)).alias("_i", "n_tokens"))
    return each.select("path", (F.col("place") + F.col("_i")).alias("place"), "n_tokens", (F.col("_i") < F.col("seps")).alias("ended"))


def block_places(blocks: DataFrame) -> DataFrame:
    """``path, block, seps, tail, place, begun, final``: documents ended before each block, ids before it of
    the document that crosses into it, and whether it is its file's last.  Two prefix scans: within stretches
    of ``SUPER`` blocks, relative to the stretch, and over the stretches."""
    few = blocks.select("path", "block", "ids", "seps", "tail", F.floor(F.col("block") / SUPER).alias("sup"))
    here = Window.partitionBy("path", "sup").orderBy("block")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    end = few.withColumn("end", F.sum("ids").over(here))
    last = F.when(F.col("seps") > 0, F.col("end") - F.col("tail"))  # where the document after a block's last separator begins
    inside = end.withColumn("last", last).select("*", F.max("last").over(before).alias("last_before"), F.coalesce(F.sum("seps").over(before), F.lit(0)).alias("seps_before"))
    sums = inside.groupBy("path", "sup").agg(F.sum("ids").alias("ids"), F.sum("seps").alias("seps"), F.max("last").alias("last"), F.max("block").alias("top"))
    along = Window.partitionBy("path").orderBy("sup")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("ids").over(past), F.lit(0))).select(
        "path", "sup", "base", F.coalesce(F.sum("seps").over(past), F.lit(0)).alias("base_seps"), F.max(F.col("base") + F.col("last")).over(past).alias("base_last"),
        F.max("top").over(Window.partitionBy("path")).alias("top"))
    begins = F.coalesce(F.col("base") + F.col("last_before"), F.col("base_last"), F.lit(0))
    return inside.join(base, ["path", "sup"]).select("path", "block", "seps", "tail", (F.col("base_seps") + F.col("seps_before")).alias("place"),
                                                     (F.col("base") + F.col("end") - F.col("ids") - begins).alias("begun"), (F.col("block") == F.col("top")).alias("final"))


def op2_separator_scan(spark, sf_dir: str) -> DataFrame:
    from .idfiles import tokenizer_path

    ws = Workspace(spark, "flat")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = f"{ws.path}/tokens"
    written = ws.keep(write_flat(docs, folder, tokenizer_path()), "written")
    counted = count_tokens(flat_files(spark, folder), width_for(SEPARATOR + 1))
    named = counted.withColumn("file", F.substring_index("path", "/", -1))
    # both sides grow with the corpus, though their files are small: no broadcast
    return named.join(written.hint("merge"), ["file", "place"]).select("doc_id", "n_tokens", "file", "place", "ended")
