"""Benchmark decontamination (operator 11), DataFrame functions only.

The windows of all benchmark items (``width`` consecutive normalised words; a
shorter item is one window) become a broadcast hash set.  Every training text
is cut into the same words, the hash of each of its windows probes the set,
and a hash that is found is verified against the window's words.  What is hit
leaves as spans (``without_spans``) or with its document (``without_documents``).

The set that is broadcast is bounded by ``MAX_ROWS`` windows and ``MAX_BYTES``
bytes of their text; a larger benchmark is dealt by hash to parts within these
bounds (a window longer than that alone makes up one), and the texts are
scanned once for each part.

Defined results: a null or empty text has no words and is not hit; an item
without words has no window; items of one id are one item, and the windows of
an item without an id hit words but name no item; rows of ``docs`` equal in id
and text are judged alike; an empty benchmark hits nothing; an empty table
gives an empty result; other columns are carried in a struct and don't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, let, row_key, table, with_struct

# Fixed values of the contract: A-Z is lower-cased, then a word is a run of digits, letters or anything beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words before they are lower-cased
WIDTH = 10

MAX_ROWS = 500_000   # windows of a benchmark that are broadcast at once
MAX_BYTES = 64 << 20  # and bytes of their text


def normal_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ITEM_WORD), F.lit(0))


def _hash(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(width)])


def _hashes(words: Column, width: int) -> Column:
    """Hash of each window of ``width`` words, in order."""
    return F.when(F.size(words) < width, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: _hash(words, i, width)))


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``item, gram, n``: each window of each item, its words joined by spaces, and how many they are."""
    words = with_struct(benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("_t")), F.struct(normal_words(F.col("_t")).alias("_w"))).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - width + 1, F.lit(1)))
    grams = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, width))).alias("_g"))
    return grams.select("item", F.array_join("_g", " ").alias("gram"), F.size("_g").alias("n")).distinct()


def _gram_hash(widths: list[int]) -> Column:
    """The hash that a text's window of the same words has."""
    out = F.lit(None).cast("bigint")
    for n in widths:
        out = F.when(F.col("n") == n, let(F.split("gram", " "), lambda w: _hash(w, F.lit(0), n))).otherwise(out)
    return out


def _decode(flat: Column, n_words: Column, widths: list[int]) -> Column:
    """Struct (at, n) of the window at a place of the hashes of all widths, one width after another."""
    out, before = F.lit(None).cast("struct<at:int,n:int>"), F.lit(0)
    cases = []
    for w in widths:
        count = F.greatest(n_words - w + 1, F.lit(0))
        cases.append((flat < before + count, F.struct((flat - before).cast("int").alias("at"), F.lit(w).alias("n"))))
        before = before + count
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def hit_windows(docs: DataFrame, grams: DataFrame, widths: list[int], text: str = "text") -> DataFrame:
    """``_k1, _k2, at, n, h, h2``: where a text holds a window of ``grams`` (``gram, n, h, h2``, within the
    bounds of a broadcast), verified word by word.  Hashes are made once a text; what follows is one
    generated loop, in which only the windows that are hit look at the words again."""
    texts = docs.select(*row_key("doc_id", text), F.col(text).alias("_t"))
    hashed = with_struct(texts, let(normal_words(F.col("_t")), lambda w: F.struct(w.alias("_w"), F.concat(*[_hashes(w, n) for n in widths]).alias("_hs"))))
    each = hashed.select("_k1", "_k2", "_w", F.posexplode_outer("_hs").alias("_flat", "_h"))  # outer: else a filter makes all hashes once more
    found = each.join(F.broadcast(grams.select("gram", F.col("n").alias("_n"), "h", "h2")), F.col("_h") == F.col("h"))
    placed = found.withColumn("_p", _decode(F.col("_flat"), F.size("_w"), widths))
    same = (F.col("_p.n") == F.col("_n")) & (F.array_join(F.slice("_w", F.col("_p.at") + 1, F.col("_n")), " ") == F.col("gram"))
    return placed.where(same).select("_k1", "_k2", F.col("_p.at").alias("at"), F.col("_n").alias("n"), "h", "h2")


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH,
              max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per document (by id and text) that is hit: ``_k1, _k2, hits`` (its places of hit words,
    in order) and ``items`` (ids of the items whose windows occur, sorted as strings)."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    windows = ws.keep(item_windows(benchmark, item, item_text, width), "windows")
    widths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # ``width`` numbers at most
    grams = windows.select("gram", "n").distinct().withColumns({"h": _gram_hash(widths), "h2": F.xxhash64(F.lit(7), "gram")})
    grams = ws.keep(grams, "grams")
    size = grams.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0)).alias("bytes")).first()
    parts = max(1, math.ceil(2 * size["rows"] / max_rows), math.ceil(2 * size["bytes"] / max_bytes)) if size["rows"] > max_rows or size["bytes"] > max_bytes else 1
    if not widths:
        return docs.sparkSession.createDataFrame([], "_k1 long, _k2 long, hits array<int>, items array<string>")
    for part in range(parts):
        one = grams.where(F.pmod(F.col("h2"), F.lit(parts)) == part) if parts > 1 else grams
        hits = hit_windows(docs, one, widths, text)
        hits.write.mode("overwrite").parquet(f"{ws.path}/hits/part={part}")
    hits = docs.sparkSession.read.schema(hits.schema).parquet(*[f"{ws.path}/hits/part={p}" for p in range(parts)])
    places = F.flatten(F.transform(F.collect_set(F.struct("at", "n")), lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))
    spans = hits.groupBy("_k1", "_k2").agg(F.sort_array(F.array_distinct(places)).alias("hits"))
    named = grams.join(windows.where("item IS NOT NULL").select("item", "gram"), "gram").select("h", "h2", "item")
    held = hits.select("_k1", "_k2", "h", "h2").distinct().join(named, ["h", "h2"]).groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    same = spans["_k1"].eqNullSafe(held["_k1"]) & (spans["_k2"] == held["_k2"])
    return spans.join(held, same, "left").select(spans["_k1"], spans["_k2"], "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def judge(docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: list[str] | None = None, **kw) -> DataFrame:
    """``row`` (the ``carry`` columns of ``docs``, by default all; what is carried is shuffled once),
    ``n_words``, ``hits`` and ``items`` (empty where nothing is hit)."""
    found = find_hits(docs.select("doc_id", text), benchmark, text, **kw)
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(RAW_WORD)).cast("bigint")
    rows = docs.select(F.struct(*[docs[c] for c in carry or docs.columns]).alias("row"), *row_key("doc_id", text), n.alias("n_words"))
    both = rows.join(found, rows["_k1"].eqNullSafe(found["_k1"]) & (rows["_k2"] == found["_k2"]), "left")
    return both.select("row", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"),
                       F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def without_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that are not hit, with the columns of ``docs``."""
    return judge(docs, benchmark, text, **kw).where(F.size("hits") == 0).select("row.*")


def _cut(text: Column, hits: Column) -> Column:
    """The text without runs of hit words (what stands before and behind a run stays)."""
    runs = F.struct(
        F.filter(hits, lambda x, k: (k == 0) | (F.get(hits, k - 1) != x - 1)).alias("s"),
        F.transform(F.filter(hits, lambda x, k: (k == F.size(hits) - 1) | (F.get(hits, k + 1) != x + 1)), lambda x: x + 1).alias("e"))

    def rest(x: Column) -> Column:
        gaps, units, starts, ends = x["gaps"], x["units"], x["r"]["s"], x["r"]["e"]
        upto = F.concat(starts, F.array(F.size(units)))
        return F.array_join(F.transform(upto, lambda s, k: let(F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1)), lambda e: F.concat(
            F.array_join(F.slice(units, e + 1, s - e), ""), F.get(gaps, s)))), "")

    cut = F.struct(F.split(text, RAW_WORD).alias("gaps"), F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)).alias("words"))
    units = let(cut, lambda c: F.struct(c["gaps"].alias("gaps"), F.zip_with(F.slice(c["gaps"], F.lit(1), F.size(c["words"])), c["words"], lambda g, w: F.concat(g, w)).alias("units"), runs.alias("r")))
    return let(units, rest)


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **kw) -> DataFrame:
    """``docs`` with the runs of hit words cut out of ``text``; other columns as they are."""
    judged = judge(docs, benchmark, text, **kw)
    clean = F.when(F.size("hits") == 0, F.col("row")[text]).otherwise(_cut(F.col("row")[text], F.col("hits")))
    made = judged.select("row", clean.alias("_clean"))
    return made.select(*[F.col("_clean").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def op11_decontamination(spark, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return judged.select("row.doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{ITEM_WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{ITEM_WORD}') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(w[k:k + {WIDTH - 1}], ' ') AS g, least(len(w), {WIDTH}) AS n
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
x AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
hit AS (SELECT x.r, x.k, x.n, g.item_id FROM (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM x) x JOIN g USING (g, n)),
p AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS q FROM hit) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
