"""Line dedup (operator 9): overlapping windows of three consecutive lines.

Every window of ``width`` consecutive lines of a document is hashed to 128
bits.  A window that also starts earlier (smaller document id, or the same
document and an earlier line) marks its lines as covered; covered lines, the
union of overlapping windows, are removed and the rest is joined again.

Defined results: a null text counts as empty; a document of fewer lines than
a window keeps all; a null id comes after all others; rows equal in id and
text are one document and treated alike; rows with one id and different texts
are ordered by a hash of the text; blank lines are lines like any other; an
empty table gives an empty result.  Columns of the input that bear the names
of helper columns are carried in a struct and don't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, let, row_key, table

WIDTH = 3  # lines to a window


def _windows(lines: Column, width: int) -> Column:
    """Array of struct(h1, h2, at): two hashes with different seeds of each window's lines."""
    at = lambda i: [F.get(lines, i + k) for k in range(width)]
    return F.when(F.size(lines) < width, F.array().cast("array<struct<h1:bigint,h2:bigint,at:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(lines) - width), lambda i: F.struct(
            F.xxhash64(F.lit(1), *at(i)).alias("h1"), F.xxhash64(F.lit(2), *at(i)).alias("h2"), i.alias("at"))))


def covered_lines(docs: DataFrame, ws: Workspace, text: str = "text", width: int = WIDTH) -> DataFrame:
    """``_k1, _k2, starts``: for each document with repeats, the starts of its windows that start earlier elsewhere.

    Windows are counted in each task before they meet, and only those found twice go on; the
    earliest of each is found the same way, so a window that a third of all rows hold is a few
    partial rows from each task.  The joins are plain sort-merge joins at every size: no side that
    grows with the corpus is broadcast, and a hot window can be split."""
    keyed = docs.select(*row_key("doc_id", text), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    lines = let(F.split("_t", "\n"), lambda x: _windows(x, width))
    windows = ws.keep(keyed.select("_k1", "_k2", F.inline(lines)), "windows")
    again = ws.keep(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), "again")
    found = ws.keep(windows.join(again.hint("merge"), ["h1", "h2"]), "found")
    place = F.struct(F.col("_k1").isNull().alias("no_id"), F.col("_k1"), F.col("_k2"), F.col("at"))
    first = ws.keep(found.groupBy("h1", "h2").agg(F.min(place).alias("_first")), "first")
    later = found.join(first.hint("merge"), ["h1", "h2"]).where(place > F.col("_first"))
    return later.groupBy("_k1", "_k2").agg(F.collect_set("at").alias("_starts"))


def _kept(lines: Column, starts: Column, width: int) -> Column:
    covered = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + width - 1)))
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    return F.transform(keep, lambda i: F.get(lines, i))


def remove_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with ``text`` rid of covered lines, and ``n_lines``, ``n_removed`` (BIGINT) beside its
    columns (in a struct ``row``, so names can't clash): columns ``row, text, n_lines, n_removed``."""
    ws = Workspace(docs.sparkSession, "lines")
    starts = ws.keep(covered_lines(docs, ws, text, width), "starts")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *row_key("doc_id", text))
    both = rows.join(starts.hint("merge"), rows._k1.eqNullSafe(starts._k1) & (rows._k2 == starts._k2), "left").select("row", "_starts")
    before = F.coalesce(F.col("row")[text], F.lit(""))
    result = let(F.split(before, "\n"), lambda x: F.when(F.col("_starts").isNull(), F.struct(
        F.col("row")[text].alias("text"), F.size(x).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_removed"))).otherwise(
        let(_kept(x, F.col("_starts"), width), lambda k: F.struct(
            F.array_join(k, "\n").alias("text"), F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(k)).cast("bigint").alias("n_removed")))))
    return both.select("row", F.inline(F.array(result)))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("kept_chars"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, array_to_string(l[i:i + {WIDTH - 1}], chr(10)) AS x
      FROM (SELECT doc_id, l, unnest(range(1, len(l) - {WIDTH - 2})) AS i FROM t WHERE len(l) >= {WIDTH})),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS p FROM later),
e AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM t),
k AS (SELECT e.doc_id, string_agg(l[e.p], chr(10) ORDER BY e.p) AS text, count(*) AS n
      FROM e LEFT JOIN cov ON e.doc_id = cov.doc_id AND e.p = cov.p WHERE cov.p IS NULL GROUP BY 1)
SELECT t.doc_id, len(l)::BIGINT AS n_lines, (len(l) - coalesce(k.n, 0))::BIGINT AS n_removed,
       length(coalesce(k.text, ''))::BIGINT AS kept_chars, sha256(coalesce(k.text, '')) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""
