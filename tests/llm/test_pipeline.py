"""The stages against plain models, and every query of the package against its SQL."""

import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from conftest import SF001
from helpers import edge_rows, frame
from respscore.llm import common
from respscore.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows():
    good = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    shared = "\n".join(f"shared line {i} of the notice" for i in range(4))
    out = [(k, good(k) + "\n" + good(k + 100) + f"\nend {k}", ["a", "b", None][k % 3]) for k in range(30)]
    out += [(100 + k, good(k + 300) + "\n" + shared + "\n" + good(k + 400), "a") for k in range(5)]
    out += [(200, out[3][1], "a"), (201, out[4][1].replace("w4x7 ", "other "), "b"), (202, "x y z " * 99, "a"), (203, None, "a"), (204, "", None)]
    return out + edge_rows()


def test_stages_in_turn(spark):
    docs = frame(spark, rows())
    kept = P.quality_rules(spark, docs, "").cache()
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(30)) <= ids and not {202, 203, 204} & ids
    lines = P.line_dedup(spark, kept, "").cache()
    text = {r.doc_id: (r.text, r.n_chars) for r in lines.collect()}
    assert lines.columns == docs.columns
    assert "shared" in text[100][0] and all("shared" not in text[100 + k][0] for k in range(1, 5))
    assert all(n == len(t) for t, n in text.values())
    assert 200 not in text  # nothing is left of an exact copy
    one = P.simhash_near_dedup(spark, lines, "").cache()
    assert one.columns == docs.columns and one.count() <= lines.count()
    mixed = P.source_mixing(spark, one, "").cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in one.collect()}
    last = P.piece_ids(spark, mixed, "")
    assert last.count() == mixed.count()
    for held in (kept, lines, one, mixed):
        held.unpersist()


def test_stages_take_empty_tables(spark):
    docs = frame(spark, rows()).limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_run_over_documents(spark):
    out = P.run(spark, SF001)
    assert out.count() > 0
    common.release_all()


def test_registered(spark):
    names = entry.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) <= set(names) and "pipeline" in names and len(P.STAGES) == 5


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_their_sql(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    res = duck.execute(ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, res.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_return_every_document(spark, name):
    df = QUERIES[name](spark, SF001)
    assert len(df.columns) == len(set(df.columns))
    ids = [r[0] for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id").collect()]
    assert sorted(r[0] for r in df.select("doc_id").collect()) == sorted(ids)


def test_entry_works_without_the_package():
    code = ("import sys, importlib.abc\n"
            "class No(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('respscore.llm', 'corpus_pipeline'): raise ModuleNotFoundError(name=name)\n"
            "sys.meta_path.insert(0, No())\n"
            "import __spark_entry__ as e\n"
            "assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
            "assert set(e.oracle_sql()) <= set(e.queries())\n")
    import os
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))
