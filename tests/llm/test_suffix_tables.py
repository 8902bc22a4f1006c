import random

import pytest

from respscore.llm import dcspark as D
from respscore.llm import suffix as S
from respscore.llm.common import Workspace

from helpers import frame
from test_suffix import hashlib, model, planted


def strings():
    rng = random.Random(4)
    out = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    return out + ["a" * 25, "a" * 26, "abcabcabcabc", out[0], "z"]


@pytest.mark.parametrize("depth", [1000, 7])
def test_ranks_order_suffixes(spark, depth):
    some = strings()
    rows = [(s, i, ord(c)) for s, x in enumerate(some) for i, c in enumerate(x)]
    ws = Workspace(spark, "ranks")
    got = {(r.s, r.i): r.r for r in D.suffix_ranks(spark.createDataFrame(rows, "s long, i int, c long").repartition(3), depth, ws).collect()}
    assert set(got) == {r[:2] for r in rows}
    groups = {}
    for (s, i), r in got.items():
        groups.setdefault(some[s][i:i + depth], []).append(r)
    at = 0
    for key in sorted(groups):  # each group keeps to its own stretch
        assert at <= min(groups[key]) and max(groups[key]) < at + len(groups[key])
        at += len(groups[key])
    ws.release()


def test_runs_that_cross_parts(spark):
    rows = [(s, 0, 5 if s < 400 else s % 3, s % 2 == 0) for s in range(600)]
    ws = Workspace(spark, "number")
    df = spark.createDataFrame(rows, "s long, i int, c long, _zero boolean")
    out, distinct = D.number(df, ["c"], ["c"], ws, "n")
    assert not distinct
    for r in out.collect():
        assert r.before == sum(x[2] < r.c for x in rows) and r.zeros_before == sum(x[2] < r.c and x[3] for x in rows)
    assert D.number(df.withColumn("c", df.s), ["c"], ["c"], ws, "m")[1]
    empty, distinct = D.number(df.limit(0), ["c"], ["c"], ws, "e")
    assert distinct and empty.count() == 0
    ws.release()


def test_all_snippets_by_the_sort_over_tables(spark):
    rows = planted(seed=3, n=40)
    want = model(rows, 100)
    got = S.remove_repeats(frame(spark, rows).repartition(5), most_bytes=0, sort_bytes=2000).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got} == want


@pytest.mark.parametrize("options", [{}, {"most_bytes": 0}])
def test_repeated_rows_whose_snippets_are_cut_elsewhere(spark, options):
    rng = random.Random(8)
    big = "".join(rng.choice("abcdefghijklmnop ") for _ in range(200_000))
    filler = "".join(rng.choice("qrstuvwxyz ") for _ in range(7001))
    rows = [(1, big, "a"), (0, filler, "a"), (1, big, "a"), (7, "end " + big[65_000:66_000], "a")]
    if options:
        big = big[65_000:66_200]
        rows = [(1, big, "a"), (0, filler[:301], "a"), (1, big, "a"), (7, "end " + big[500:900], "a")]
    df = frame(spark, rows).repartition(1)
    got = S.remove_repeats(df, **options).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (7, 400 if options else 1000)]
