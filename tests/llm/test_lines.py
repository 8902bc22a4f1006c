import random

from helpers import edge_rows, frame
from respscore.llm import linededup as L


def model(docs, width=3):
    """(id, text) in order -> kept text by place."""
    first, out = {}, []
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    for k in order:
        lines = (docs[k][1] or "").split("\n")
        covered = set()
        for i in range(len(lines) - width + 1):
            w = tuple(lines[i:i + width])
            if first.setdefault(w, (docs[k][0], docs[k][1], i)) != (docs[k][0], docs[k][1], i):
                covered |= set(range(i, i + width))
        out.append((k, "\n".join(x for i, x in enumerate(lines) if i not in covered), len(lines), len(covered)))
    return [x[1:] for x in sorted(out)]


def test_against_a_plain_model(spark):
    rng = random.Random(3)
    stock = [f"line {k}" for k in range(9)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(stock) for _ in range(rng.randint(0, 14))), "a") for i in range(60)]
    rows += [r for r in edge_rows() if r[0] is not None and r[0] != 3]
    rows = list({r[0]: (r[0] + (1000 if n >= 60 else 0), *r[1:]) for n, r in enumerate(rows)}.values())
    rows += [rows[5], rows[5]]  # equal rows are one document
    want = model(rows)
    docs = frame(spark, rows)
    got = L.remove_repeats(docs).collect()
    key = lambda x: (x[0], str(x[1]))
    assert sorted(((r.row.doc_id, r.text or "", r.n_lines, r.n_removed) for r in got), key=key) == sorted(
        ((rows[k][0], *w) for k, w in enumerate(want)), key=key)
    assert got[0].row.asDict().keys() == {f.name for f in docs.schema}


def test_null_ids_come_last_and_texts_stay_null(spark):
    t = "a\nb\nc"
    got = {(r.row.doc_id, r.row.source): (r.text, r.n_removed) for r in L.remove_repeats(frame(spark, [(None, t, "x"), (5, t, "y"), (6, None, "z")])).collect()}
    assert got == {(5, "y"): (t, 0), (None, "x"): ("", 3), (6, "z"): (None, 0)}
    assert L.remove_repeats(frame(spark, []).limit(0)).count() == 0


def test_one_window_in_every_document_and_a_long_text(spark):
    rows = [(i, f"own {i}\nx\ny\nz\nend {i}", "a") for i in range(300)] + [(999, "\n".join(f"l{k % 700}" for k in range(3000)), "a")]
    got = {r.row.doc_id: (r.text, r.n_removed) for r in L.remove_repeats(frame(spark, rows)).collect()}
    assert got[0][1] == 0 and all(got[i] == (f"own {i}\nend {i}", 3) for i in range(1, 300))
    assert got[999][1] == 2300
