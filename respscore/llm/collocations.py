"""Phrase collocation mining (operator 13), set-oriented as in SETM.

Relations of occurrences are kept sorted by place: ``R1`` holds each word's
place and id, ``Rk`` the places at which a frequent phrase of k words starts.
One step merge-joins ``Rk`` with itself on adjacent places of one piece (the
phrases overlap in all but one word), counts the groups (k+1 words each, named
by the ids of prefix and suffix), keeps those of ``min_count`` and semi-joins
the occurrences with them before the next step.

A relation's rows are runs of some ``BLOCK`` places; a piece is never cut, and
places of different pieces are never adjacent.  Both sides of the join lie in
one run and in order, so the join passes over it once, in place, without a
shuffle.  What is shuffled are counts, summed in each task first.  Words are
hashed to 64 bits with their language and counted by their letters; if a
frequent word shares its hash with any other, all is hashed anew with another
seed.  Phrases have exact ids.

The semi-join reads the frequent groups in each task while there are at most
``shared`` of them (a bound, sent once to each executor); beyond it occurrences
meet them by shuffle and return to their runs.  Both ways give the same rows.

Defined results: a null or empty text has no words; a null language is
``und``; repeated rows count as often as they occur; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, table, text_slices

# Fixed values of the contract.
BLANK = b" \t"
BREAKS = b".,;:!?\n\x0b\x0c\r"
NO_LANG = "und"
MIN_COUNT = 30
TOP = 2000
COVERED_PCT = 80
SCORE_SCALE = 2_000_000
LONGEST = 4  # words; a phrase of four has three cuts, whose parts' counts the steps before have made

BLOCK = 128             # occurrences of a run, unless one piece is longer: Spark hands a task some 10,000 runs at once
SLICE_BYTES = 4 << 20   # text that a task cuts at once
SHARED = 1 << 21        # frequent groups that each task reads whole (12 bytes each)
BUCKETS = 64            # parts that are ranked before a language is ranked

_KIND = np.zeros(256, np.int8)
_KIND[list(BLANK)] = 1
_KIND[list(BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

RELATION = "at array<int>, key array<bigint>"


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words of all texts in order, each one's place, each one's text); between pieces a place is left out."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    kind = _KIND[raw]
    inside, first = kind == 0, np.zeros(len(raw) + 1, bool)
    first[offsets] = True  # a text's first byte ends any word or piece before it
    edge = first.copy()
    edge[1:] |= np.append(~inside, True)[:-1]
    starts = np.flatnonzero(inside & edge[:-1])
    edge = first[1:].copy()
    edge[:-1] |= ~inside[1:]
    ends = np.flatnonzero(inside & edge) + 1
    piece = np.cumsum((kind == 2) | first[:-1], dtype=np.int32)[starts]
    place = np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(_LOWER[raw[inside]]))
    return words, place, np.searchsorted(offsets, starts, side="right") - 1


def _runs(place: np.ndarray, size: int) -> np.ndarray:
    """Bounds of runs of about ``size`` occurrences that cut no piece."""
    fresh = np.flatnonzero(np.diff(place, prepend=-2) > 1)  # the first occurrence of each piece
    wanted = np.arange(size, len(place), size)
    at = np.searchsorted(fresh, wanted)
    inner = fresh[at[at < len(fresh)]]
    return np.unique(np.concatenate([[0], inner, [len(place)]])).astype(np.int64)


def occurrences(docs: DataFrame, text: str, lang: str, seed: int, block: int) -> DataFrame:
    """Rows of two kinds: runs of occurrences (``at``, ``key``: hashes of words), and the words of each
    slice of texts with their counts (``words``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for texts, langs in text_slices(batch, "_text", "_lang", SLICE_BYTES):
                words, place, of = cut_words(texts)
                if not len(words):
                    continue
                coded, spoken = words.dictionary_encode(), langs.dictionary_encode()
                names, letters = spoken.dictionary.to_pylist(), coded.dictionary
                pair = spoken.indices.to_numpy().astype(np.int64)[of] * len(letters) + coded.indices.to_numpy()
                pair, which, n = np.unique(pair, return_inverse=True, return_counts=True)
                seeds = [xxhash.xxh3_64_intdigest(x.encode(), seed) for x in names]
                used = letters.take(pa.array(pair % len(letters)))
                speaker = pair // len(letters)
                hashes = np.array([xxhash.xxh3_64_intdigest(w, seeds[k]) for w, k in zip(used.cast(pa.binary()).to_pylist(), speaker.tolist(), strict=True)], np.uint64).view(np.int64)
                bounds = _runs(place, block)
                rows = len(bounds) - 1
                base = np.repeat(place[bounds[:-1]], np.diff(bounds))
                told = pa.StructArray.from_arrays([spoken.dictionary.take(pa.array(speaker)), used, pa.array(hashes), pa.array(n)], ["lang", "word", "h", "n"])
                yield pa.RecordBatch.from_arrays([
                    _lists((place - base).astype(np.int32), np.append(bounds, bounds[-1])), _lists(hashes[which], np.append(bounds, bounds[-1])),
                    pa.ListArray.from_arrays(pa.array([0] * (rows + 1) + [len(told)], pa.int32()), told)], names=["at", "key", "words"])

    rows = docs.select(F.col(text).alias("_text"), F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("_lang"))
    return rows.mapInArrow(run, RELATION + ", words array<struct<lang:string,word:string,h:bigint,n:bigint>>")


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run of each occurrence, its place, its value) of a batch of a relation."""
    at, key = batch.column("at"), batch.column(column)
    runs = np.repeat(np.arange(len(at)), pc.list_value_length(at).to_numpy())
    return runs, at.flatten().to_numpy(), key.flatten().to_numpy()


def _adjacent(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merge-join of a sorted relation with itself on adjacent places: (run, place, both ids as one key)."""
    runs, at, ids = _flat(batch, "id")
    here = np.flatnonzero((at[1:] == at[:-1] + 1) & (runs[1:] == runs[:-1]))
    return runs[here], at[here], ids[here].astype(np.int64) << 32 | ids[here + 1]


def _relation(rows: int, runs: np.ndarray, at: np.ndarray, value: np.ndarray, name: str) -> pa.RecordBatch:
    bounds = np.searchsorted(runs, np.arange(rows + 1))
    return pa.RecordBatch.from_arrays([_lists(at, bounds), _lists(value, bounds)], names=["at", name])


def group_counts(relation: DataFrame) -> DataFrame:
    """``key, n``: how often each two phrases of a relation stand at adjacent places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = np.unique(_adjacent(batch)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    return relation.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def frequent_only(relation: DataFrame, frequent: DataFrame, joined: bool, shared: int) -> DataFrame:
    """``at, id``: the occurrences whose key is in ``frequent`` (``key, id``; as many as ids).  With ``joined``
    the keys are those of adjacent occurrences of ``relation``, else its column ``key``."""
    spark = relation.sparkSession
    keys = (lambda b: _adjacent(b)) if joined else (lambda b: _flat(b, "key"))
    if frequent.count() <= shared:
        told = frequent.select("key", "id").toArrow()
        order = np.argsort(told["key"].to_numpy())
        known = spark.sparkContext.broadcast((told["key"].to_numpy()[order], told["id"].to_numpy()[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_keys, ids = known.value
            for batch in batches:
                runs, at, key = keys(batch)
                distinct, which = np.unique(key, return_inverse=True)
                place = np.searchsorted(all_keys, distinct)
                place[place == len(all_keys)] = 0
                hit = (all_keys[place] == distinct)[which] if len(all_keys) else np.zeros(len(key), bool)
                yield _relation(batch.num_rows, runs[hit], at[hit], ids[place[which[hit]]] if hit.any() else np.zeros(0, np.int32), "id")

        return relation.mapInArrow(run, "at array<int>, id array<int>")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _relation(batch.num_rows, *keys(batch), "key")

    rows = relation.mapInArrow(make, RELATION) if joined else relation.select("at", "key")
    flat = rows.withColumn("_run", F.monotonically_increasing_id()).select("_run", F.inline(F.arrays_zip("at", "key")))
    kept = flat.join(frequent.select("key", "id").hint("merge"), "key").groupBy("_run").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("_o"))
    return kept.select(F.col("_o.at").alias("at"), F.col("_o.id").alias("id"))


def with_ids(ws: Workspace, frequent: DataFrame, name: str) -> DataFrame:
    """``frequent`` with an ``id`` from 0 on without gaps, as a table: its partitions' sizes are summed first."""
    kept = ws.keep(frequent.withColumn("_m", F.monotonically_increasing_id()), f"{name}_rows")
    sizes = kept.groupBy(F.shiftright("_m", 33).cast("int").alias("_p")).agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect()  # one row per partition
    before, total = [], 0
    for r in sizes:
        before.append((r["_p"], total))
        total += r["n"]
    if total >= 1 << 31:
        raise ValueError("more frequent phrases than ids of 31 bits")
    first = ws.spark.createDataFrame(before, "_p int, _before long")
    numbered = kept.withColumn("_p", F.shiftright("_m", 33).cast("int")).join(F.broadcast(first), "_p")
    return ws.keep(numbered.withColumn("id", (F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")).drop("_m", "_p", "_before"), name)


def _first_level(ws: Workspace, docs: DataFrame, text: str, lang: str, min_count: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(R1 by hash, all words with their counts, frequent words with ids)."""
    for seed in range(100):
        raw = ws.keep(occurrences(docs, text, lang, seed, block), "occurrences")
        words = ws.keep(raw.where("words IS NOT NULL").select(F.inline("words")).groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), f"words{seed}")
        often = words.where(F.col("n") >= min_count)
        o, w = often.select(F.col("h").alias("_h"), F.col("lang").alias("_l"), F.col("word").alias("_w")), words
        clash = w.join(o, (F.col("h") == F.col("_h")) & ((F.col("lang") != F.col("_l")) | (F.col("word") != F.col("_w"))))
        if clash.isEmpty():
            return raw.where(F.size("at") > 0).select("at", "key"), words, with_ids(ws, often.withColumnRenamed("h", "key"), "level1")
        ws.drop("occurrences")
    raise RuntimeError("no seed keeps the hashes of frequent words apart")


def _extend(counted: DataFrame, shorter: DataFrame) -> DataFrame:
    """Frequent groups with what their prefix and suffix, one word shorter, tell of them."""
    side = lambda s: shorter.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "lang", "words", "a", "head", "tail", "p", "s", "pa", "sa")])
    both = counted.withColumns({"p": F.shiftright("key", 32).cast("int"), "s": F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")})
    x, y = side("x"), side("y")
    j = both.join(x, both["p"] == x["x_id"]).join(y, both["s"] == y["y_id"])
    return j.select("key", "id", F.col("x_lang").alias("lang"), F.concat("x_words", F.slice("y_words", -1, 1)).alias("words"), F.col("n").alias("a"),
                    F.col("x_head").alias("head"), F.col("y_tail").alias("tail"), "p", "s", F.col("x_a").alias("pa"), F.col("y_a").alias("sa"),
                    F.col("x_pa").alias("p2a"), F.col("y_sa").alias("s2a"), F.col("x_p").alias("pp"), F.col("x_s").alias("ps"), F.col("y_s").alias("ss"))


def _best_cut(cuts: list[tuple[str, str]]) -> Column:
    """The lowest-scoring cut (struct score, k, l, r), ties to the shortest first part; exact in DECIMAL."""
    wide = "decimal(20,0)"
    made = [F.struct(F.expr(f"({SCORE_SCALE} * cast(a as {wide})) div (cast({x} as {wide}) + cast({y} as {wide}))").alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r"))
            for k, (x, y) in enumerate(cuts, 1)]
    return F.array_min(F.array(*made))


_CUTS = {2: [("head", "tail")], 3: [("head", "sa"), ("pa", "tail")], 4: [("head", "sa"), ("p2a", "s2a"), ("pa", "tail")]}


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST,
            block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """``lang, phrase, n_words, a, l, r, n, score`` of every candidate that no longer one covers."""
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"longest must be 2 to {LONGEST}")
    ws = Workspace(docs.sparkSession, "collocations")
    relation, words, first = _first_level(ws, docs, text, lang, min_count, block)
    n = F.col("n")
    level = {1: first.select("id", "lang", F.array("word").alias("words"), n.alias("a"), n.alias("head"), n.alias("tail"),
                             *[F.lit(None).cast(k).alias(c) for c, k in (("p", "int"), ("s", "int"), ("pa", "bigint"), ("sa", "bigint"))])}
    relation = ws.keep(frequent_only(relation, first, False, shared), "r1")
    ws.drop("occurrences")
    for k in range(2, longest + 1):
        counted = with_ids(ws, group_counts(relation).where(F.col("n") >= min_count), f"level{k}")
        level[k] = ws.keep(_extend(counted, level[k - 1]), f"phrases{k}")
        if k < longest:
            relation = ws.keep(frequent_only(relation, counted, True, shared), f"r{k}")
            ws.drop(f"r{k - 1}")
    none = docs.sparkSession.createDataFrame([], "id int, most bigint")
    inside = lambda k, *ids: level[k].select(F.explode(F.array(*ids)).alias("id"), F.col("a").alias("most")) if k in level else none
    covers = {2: inside(3, "p", "s").unionByName(inside(4, "pp", "ps", "ss")), 3: inside(4, "p", "s"), 4: none}
    parts = []
    for k in range(2, longest + 1):
        most = covers[k].groupBy("id").agg(F.max("most").alias("most"))
        free = level[k].join(most, "id", "left").where(F.expr(f"most IS NULL OR 100 * cast(most as decimal(20,0)) < {COVERED_PCT} * cast(a as decimal(20,0))"))
        parts.append(free.select("lang", F.array_join("words", " ").alias("phrase"), F.lit(k).alias("n_words"), "a", _best_cut(_CUTS[k]).alias("_c")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return out.join(total, "lang").select("lang", "phrase", "n_words", "a", F.col("_c.l").alias("l"), F.col("_c.r").alias("r"), "n", F.col("_c.score").alias("score"))


def top_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with their ``rank``.  Parts of a language are ranked first, so at
    most ``BUCKETS`` times ``top`` rows of it meet."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    some = found.withColumn("_b", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))
    some = some.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_b").orderBy(*order))).where(F.col("_r") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top).drop("_b", "_r")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return top_phrases(phrases(table(spark, sf_dir, "documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = rf"""
WITH t AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM t)),
f AS (SELECT lang, ph, k, count(*) AS a FROM (
        SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS ph FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {LONGEST + 1}) AS s(k) WHERE len(w) >= k)) GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(ph, ' ') AS w FROM f WHERE k > 1 AND a >= {MIN_COUNT}),
cut AS (SELECT c.lang, c.ph, c.a, c.cutat AS first, x.a AS l, y.a AS r, ({SCORE_SCALE}::HUGEINT * c.a) // (x.a + y.a) AS score
        FROM (SELECT lang, ph, a, cutat, array_to_string(w[1:cutat], ' ') AS p1, array_to_string(w[cutat + 1:k], ' ') AS p2 FROM (SELECT *, unnest(range(1, k)) AS cutat FROM c)) c
        JOIN f x ON x.lang = c.lang AND x.ph = c.p1 JOIN f y ON y.lang = c.lang AND y.ph = c.p2),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, first) = 1),
inside AS (SELECT lang, ph, max(a) AS most FROM (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS ph, a FROM (
        SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, {LONGEST}) AS s(m) WHERE m < k)) GROUP BY ALL),
kept AS (SELECT best.*, ph AS phrase FROM best LEFT JOIN inside USING (lang, ph)
         WHERE most IS NULL OR 100::HUGEINT * most < {COVERED_PCT}::HUGEINT * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
       n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= {TOP}
"""
