import hashlib
import re

from helpers import edge_rows, frame, words
from respscore.llm import decontaminate as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return re.findall(D.ITEM_WORD, (text or "").translate(LOWER))


def windows(items, width=10):
    """Each window of each item, and the names of the items that hold it."""
    out = {}
    for name, item in items:
        w = cut(item)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            out.setdefault(tuple(w[k:k + n]), set()).update([str(name)] if name is not None else [])
    return out


def model(text, items, width=10):
    """(n_words, places hit, items) of one text, by looking at every place."""
    w, hits, found = cut(text), set(), set()
    held = items if isinstance(items, dict) else windows(items, width)
    for n in {len(g) for g in held}:
        for i in range(len(w) - n + 1):
            if (g := tuple(w[i:i + n])) in held:
                hits |= set(range(i, i + n))
                found |= held[g]
    return len(w), sorted(hits), sorted(found)


def bench(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id string, text string, n int, gram string")


def case(seed=5):
    import random

    rng = random.Random(seed)
    items = [("q1", " ".join(words(rng, 25))), ("q2", " ".join(words(rng, 12)).upper()), ("q10", "Only, four-words HERE"), ("q10", "Éà Ñ 中文!"), ("e", ""), ("n", None),
             (None, "an item without id"), ("q3", " ".join(words(rng, 10)))]
    items.append(("twin", items[0][1]))
    inside = cut(items[0][1])
    rows = edge_rows(seed, 12)
    rows += [(2000, "x y " + " ".join(inside[3:15]) + " z", "a"), (2001, "; ".join(inside) + " " + ". ".join(inside), "b"), (2002, " ".join(inside[:9]), "a"),
             (2003, "here only four words here, only four words here.", "a"), (2004, "éà ñ 中文 Éà ñ 中文", "b"), (2005, items[1][1].lower(), "a"), (2006, "An ITEM (without) id", None),
             (2007, " ".join([items[1][1]] * 40), "a")]
    rows += [rows[-1], (None, rows[-2][1], "a")]
    return rows, items


def test_against_a_plain_model(spark):
    rows, items = case()
    docs = frame(spark, rows)
    got = D.judge(docs, bench(spark, items)).collect()
    assert got[0].row.asDict().keys() == {f.name for f in docs.schema}
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r.row.doc_id, r.row.text, r.n_words, r.hits, r["items"]) for r in got), key=key) == sorted(((i, t, *model(t, items)) for i, t, _ in rows), key=key)
    assert any(len(r["items"]) > 1 for r in got) and any(r.hits and not r["items"] for r in got)


def test_a_benchmark_above_the_bounds_is_scanned_in_parts(spark):
    rows, items = case(6)
    docs, b = frame(spark, rows), bench(spark, items)
    key = lambda r: (str(r.row.doc_id), str(r.row.text))
    whole, parts = (sorted(D.judge(docs, b, **kw).collect(), key=key) for kw in ({}, {"max_rows": 9}))
    assert whole == parts == sorted(D.judge(docs, b, max_bytes=400).collect(), key=key)


def test_removing_spans_and_documents(spark):
    rows, items = case(7)
    docs, b = frame(spark, rows), bench(spark, items)
    clean = D.without_documents(docs, b)
    assert clean.columns == docs.columns
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=key) == sorted(((i, t) for i, t, _ in rows if not model(t, items)[1]), key=key)

    def without(text):
        hits = set(model(text, items)[1])
        if not hits:
            return text
        out, at = "", 0
        for k, m in enumerate(re.finditer(D.RAW_WORD, text)):
            if k not in hits or k - 1 not in hits:
                out += text[at:m.start()]
            out += "" if k in hits else m.group()
            at = m.end()
        return out + text[at:]

    cutted = D.without_spans(docs, b)
    assert cutted.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in cutted.collect()), key=key) == sorted(((i, without(t)) for i, t, _ in rows), key=key)


def test_empty_tables(spark):
    rows, items = case(8)
    docs, b = frame(spark, rows), bench(spark, items)
    assert D.judge(docs.limit(0), b).count() == 0
    assert all(r.hits == [] and r["items"] == [] for r in D.judge(docs, b.limit(0)).collect())


def test_registered_query_has_the_digests(spark):
    from conftest import SF001

    got = D.op11_decontamination(spark, SF001).collect()
    items = windows([(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert len(got) == len(texts) and any(r.contaminated for r in got)
    for r in got[:60] + [r for r in got if r.contaminated]:
        n, hits, found = model(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, len(hits), len(found), hashlib.sha256(",".join(found).encode()).hexdigest())


def test_no_python_on_the_main_path(spark):
    from conftest import SF001

    plan = D.op11_decontamination(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
