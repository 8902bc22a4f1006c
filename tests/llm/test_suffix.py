import hashlib
import random

import numpy as np
import pytest

from helpers import edge_rows, frame
from respscore.llm import suffix as S
from respscore.llm.dc3 import suffix_array


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(600):
        n, top = rng.randint(0, 40), rng.choice([1, 2, 3, 9])
        s = np.array([rng.randint(1, top) for _ in range(n)], dtype=np.int64)
        assert suffix_array(s, top).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    s = np.random.default_rng(0).integers(1, 1 << 22, 5000)  # names too wide for one key
    s[2500:] = s[:2500]
    assert suffix_array(s, 1 << 22).tolist() == sorted(range(5000), key=lambda i: s[i:].tolist())


def model(rows, length):
    """Naive: every string in order of document and place."""
    seen, out = {}, {}
    for i, t in sorted({(i, t) for i, t, _ in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if seen.setdefault(raw[p:p + length], (i, p)) != (i, p):
                gone[p:p + length] = True
        runs = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1)
        out[i] = (len(raw), int(gone.sum()), len(runs), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def planted(seed=2, n=60):
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é\n") for _ in range(k))
    stock = [letters(rng.randint(60, 400)) for _ in range(6)]
    rows = []
    for i in range(n):
        rows.append((i, "".join(rng.choice(stock) if rng.random() < 0.5 else letters(rng.randint(1, 150)) for _ in range(rng.randint(1, 6))), "a"))
    rows += [(i + 100, t, s) for i, t, s in {r[0]: r for r in edge_rows() if r[0] is not None}.values()]
    rows += [(5000, "ab" * 400, "a"), (5001, "x" * 900, "a"), (5002, "x" * 99, "a"), (5003, rows[7][1], "a"), (None, rows[8][1] + "tail", "a")]
    return rows


@pytest.mark.parametrize("options", [{}, {"most_bytes": 300, "sort_bytes": 2000}, {"filter_bits": 8}, {"length": 40}])
def test_removal_matches_brute_force(spark, options):
    rows = planted()
    want = model(rows, options.get("length", 100))
    got = S.remove_repeats(frame(spark, rows).repartition(5), **options).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got} == want
    assert len(got) == len(rows)


def test_one_passage_in_every_document(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(300))
    own = lambda: "".join(rng.choice("klmnopqrst ") for _ in range(150))
    rows = [(i, own() + passage + own(), "a") for i in range(200)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in S.remove_repeats(frame(spark, rows)).collect()}
    assert got[0] == (0, 0) and all(got[i][0] >= 300 for i in range(1, 200))


def test_repeated_rows_and_empty_tables(spark):
    row = (1, "some text " * 30, "a")
    got = S.remove_repeats(frame(spark, [row, row, (2, None, "a")])).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in got) == sorted([(1, model([row], 100)[1][1], 1)] * 2 + [(2, 0, 0)])
    assert S.remove_repeats(frame(spark, [row]).limit(0)).count() == 0


def test_a_text_longer_than_a_slice(spark, monkeypatch):
    rng = random.Random(9)
    long_ = "".join(rng.choice("abcdefgh ") for _ in range(6 << 20))
    rows = [(1, long_, "a"), (2, "own " + long_[5 << 20:(5 << 20) + 500], "a"), (3, long_[(4 << 20) - 300:(4 << 20) + 300], "a")]
    got = {r.doc_id: r.n_removed for r in S.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 500, 3: 600}
