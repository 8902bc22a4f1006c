"""Frozen-baseline scoring, batch and Structured Streaming."""

import os

from conftest import SF001, make_history
from respscore.plans.api import rank
from respscore.sources.tables import history_from_tables
from respscore.streaming.baseline import fit_baseline, load_baseline, save_baseline, score


def test_baseline_on_own_data_equals_rank(spark):
    h = history_from_tables(spark, SF001)
    b = fit_baseline(h)
    got = {r.id: r["rank"] for r in score(h, b).collect()}
    want = {r.id: r["rank"] for r in rank(h).collect()}
    assert got == want and len(got) == 200


def test_unseen_status_and_type_are_rare(spark):
    base = make_history(spark, [("a", 200, "text/html", "x"), ("b", 200, "text/html", "x")])
    b = fit_baseline(base)
    new = make_history(spark, [("n", 418, "teapot/x", "x")])
    r = score(new, b).first()
    # length 1 == mean, sd 0 -> 1; status and type rarity 1; hamming 0  -> (0+1+1)/3*.5*100
    assert r["rank"] == 33


def test_save_load_round_trip(spark, scratch):
    h = history_from_tables(spark, SF001)
    b = fit_baseline(h)
    save_baseline(b, os.path.join(scratch, "baseline"))
    b2 = load_baseline(spark, os.path.join(scratch, "baseline"))
    assert b2.stats == b.stats
    a = sorted(tuple(r) for r in score(h, b).collect())
    c = sorted(tuple(r) for r in score(h, b2).collect())
    assert a == c


def test_stream_scoring_matches_batch(spark, scratch):
    h = history_from_tables(spark, SF001)
    b = fit_baseline(h)
    src = os.path.join(scratch, "incoming")
    h.where("id % 2 = 0").write.parquet(os.path.join(src, "batch1"))
    h.where("id % 2 = 1").write.parquet(os.path.join(src, "batch2"))
    stream = spark.readStream.schema(h.schema).parquet(os.path.join(src, "*"))
    q = (score(stream, b).writeStream.format("memory").queryName("scored_stream")
         .option("checkpointLocation", os.path.join(scratch, "ckpt")).outputMode("append").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.id: r["rank"] for r in spark.table("scored_stream").collect()}
    want = {r.id: r["rank"] for r in score(h, b).collect()}
    assert got == want
