"""A training corpus from ``documents``: quality rules, line dedup, near-duplicates, mixing, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respscore.llm import linededup, mixing, piecebpe, quality, simhash
from respscore.llm.common import Workspace, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    return quality.keep_passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of lines that occur earlier (``n_chars`` follows the text, a null one stays null);
    a document of which no line is left goes."""
    out = linededup.remove_repeats(docs).where("n_removed = 0 OR n_removed < n_lines")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars"))
    changed = {"text": F.col("text"), "n_chars": n_chars}
    return out.select(*[changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, repeats included, in shards of random order."""
    return mixing.mix_documents(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document of the mix, and the digest of what they decode to."""
    coded = piecebpe.encode(docs.select("doc_id", "lang", "source", "text"), piecebpe.model_path(), decoded="_decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("_decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("piece_ids", piece_ids),
]

# SimHash and the seeded mix can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes when the next one is written."""
    ws = Workspace(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return docs
