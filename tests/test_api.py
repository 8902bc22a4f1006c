"""Public API entry points and session helpers."""

import pytest

import respscore
from conftest import SF001
from respscore.session import configured_checkpoint_dir, materialize, release, released
from respscore.sources.tables import history_from_tables


@pytest.fixture(scope="module")
def hist(spark):
    return history_from_tables(spark, SF001)


def test_profile_golden(hist):
    r = respscore.profile(hist).collect()
    assert len(r) == 1
    p = r[0]
    assert p.n == 200 and p.mean_length == 2479.46
    assert abs(p.sd_length - 2852.509628099439) < 1e-9
    assert p.centroid == "08a25707b54b2461"
    m = respscore.profile(hist, centroid="majority").first()
    assert m.centroid == "08b549073559d17c"


def test_scan_and_rank_empty_and_limited(hist):
    assert respscore.scan_and_rank(hist, filter="status_code = 999").count() == 0
    r = respscore.scan_and_rank(hist, limit=100, filter="has_response").collect()
    assert len(r) == 100 and all(0 <= x["rank"] <= 100 for x in r)


def test_top_k_is_prefix_of_full_order(hist):
    full = [tuple(r) for r in respscore.rank(hist).collect()]
    top = [tuple(r) for r in respscore.rank(hist, top=10).collect()]
    assert top == full[:10]



def test_checkpoint_dir_from_session(spark):
    assert configured_checkpoint_dir(spark)
    df = materialize(spark.range(5), "checkpoint")
    assert df.count() == 5
    with pytest.raises(ValueError):
        materialize(spark.range(1), "bogus")


def test_rank_by_keyword(hist):
    from pyspark.sql import functions as F

    h = hist.withColumn("g", F.lit(1))
    a = {r.id: r["rank"] for r in respscore.rank(h, by=["g"]).collect()}
    b = {r.id: r["rank"] for r in respscore.rank(hist).collect()}
    assert a == b


def test_results_can_be_released(spark, hist):
    import os

    def left():
        folder = configured_checkpoint_dir(spark).removeprefix("file://").removeprefix("file:")
        return {f for f in os.listdir(folder) if f.startswith("respscore-")} if os.path.isdir(folder) else set()

    def cached():
        return set(spark.sparkContext._jsc.getPersistentRDDs())

    release()
    before, held = left(), cached()
    with released():
        assert respscore.rank(hist).count() == 200
        assert left() > before
        respscore.rank(hist, by=["status_code"], materialize_how="persist").count()
        assert cached() > held
    assert left() == before and cached() == held
