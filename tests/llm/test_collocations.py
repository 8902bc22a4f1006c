import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from helpers import edge_rows, frame
from respscore.llm import collocations as C
from respscore.llm.common import Workspace

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def model(rows, least, longest=4):
    """Every candidate that stays: (lang, phrase, words, a, l, r, n, score)."""
    f, total, out = Counter(), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    for p, a in often.items():
        lang, w = p[0], p[1:]
        longer = [b for q, b in often.items() if q[0] == lang and len(q) > len(p) and any(q[i:i + len(w)] == w for i in range(1, len(q) - len(w) + 1))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        score, k = min((2000000 * a // (f[p[:k + 1]] + f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), len(w), a, f[p[:k + 1]], f[(lang, *w[k:])], total[lang], score))
    return out


def sample(seed=3):
    rng = random.Random(seed)
    stock = ["the cat sat", "on the mat", "new york city hall", "red  dog", "A b A b A b", "é ñ", "the cat ran", "x"]
    texts = [rng.choice(["", " ", "\t"]).join([]) + "".join(rng.choice(stock) + rng.choice([" ", " ", "\t", ". ", ",", "\n", " ;! "]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = [(rng.choice(["en", "fr", None, "und", ""]), t) for t in texts] + [("en", t) for _, t, _ in edge_rows(seed, 10)] + [("en", "the the the " * 900)]
    return rows + rows[:5]


def docs(spark, rows):
    data = [(i, t, lang, 1, [2], "k") for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, n long, at array<int>, key string")


@pytest.mark.parametrize("kw", [{}, {"block": 3}, {"shared": 4}, {"longest": 3}, {"longest": 2, "shared": 0}])
def test_against_a_plain_model(spark, kw):
    rows = sample()
    got = C.phrases(docs(spark, rows), min_count=5, **kw).collect()
    want = model(rows, 5, kw.get("longest", 4))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20


def test_words_and_places():
    texts = pa.array(["The cat. sat", None, "", "a", "b c", "!x;y z\t\tÉa", " "])
    words, place, of = C.cut_words(texts)
    assert words.to_pylist() == ["the", "cat", "sat", "a", "b", "c", "x", "y", "z", "Éa"]
    assert place.tolist() == [0, 1, 3, 5, 7, 8, 10, 12, 13, 14] and of.tolist() == [0, 0, 0, 3, 4, 4, 5, 5, 5, 5]
    words, place, of = C.cut_words(texts.slice(3, 2))
    assert words.to_pylist() == ["a", "b", "c"] and of.tolist() == [0, 1, 1]
    assert len(C.cut_words(pa.array([], pa.string()))[0]) == 0


def test_a_shared_hash_is_hashed_anew(spark, monkeypatch):
    rows = sample(4)
    tried = []
    real = C.occurrences

    def first_clashes(d, text, lang, seed, block):
        tried.append(seed)
        out = real(d, text, lang, seed, block)
        same = "transform(words, x -> struct(x.lang as lang, x.word as word, cast(7 as bigint) as h, x.n as n))"
        return out.selectExpr("at", "transform(key, x -> cast(7 as bigint)) as key", f"{same} as words") if seed == 0 else out

    monkeypatch.setattr(C, "occurrences", first_clashes)
    got = C.phrases(docs(spark, rows), min_count=5).collect()
    assert tried == [0, 1] and sorted(map(tuple, got)) == sorted(model(rows, 5))


def test_top_of_each_language_with_ties(spark):
    rows = sample(6)
    found = C.phrases(docs(spark, rows), min_count=5)
    got = C.top_phrases(found, 7).select("lang", "rank", "phrase").collect()
    want = []
    by = sorted(model(rows, 5), key=lambda r: (r[0], -r[7], -r[3], r[1].encode()))
    for lang in {r[0] for r in by}:
        want += [(lang, k, r[1]) for k, r in enumerate([r for r in by if r[0] == lang][:7], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_exact_beyond_64_bits(spark):
    big = 9 * 10 ** 18
    row = spark.createDataFrame([(big, big, big + 10 ** 17)], "a long, head long, tail long").select(C._best_cut([("head", "tail")]).alias("c")).first()["c"]
    assert row.score == 2000000 * big // (big + big + 10 ** 17)


def test_ids_without_gaps(spark):
    ws = Workspace(spark, "ids")
    got = C.with_ids(ws, spark.range(1000).repartition(7).withColumnRenamed("id", "x"), "t").collect()
    assert sorted(r.id for r in got) == list(range(1000)) and sorted(r.x for r in got) == list(range(1000))
    ws.release()


def test_empty_tables(spark):
    assert C.phrases(docs(spark, sample()).limit(0)).count() == 0
    assert C.phrases(docs(spark, [("en", None), (None, ""), ("en", ". ,")]), min_count=1).count() == 0
