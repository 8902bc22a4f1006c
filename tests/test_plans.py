"""Plan-shape checks (public ``explain`` output): the properties the design
relies on at scale must not regress."""

import contextlib
import io
import re

import pytest

from conftest import SF001
from respscore.functions.simhash import simhash_frame
from respscore.operators.features import response_features
from respscore.operators.profile import fingerprint_frequency, summary
from respscore.plans.api import rank
from respscore.sources.history import scan_history
from respscore.sources.tables import history_from_tables, read_table


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def nodes(p: str, name: str) -> int:
    """Physical operators called ``name`` (detail headers "(k) name")."""
    return len(re.findall(rf"^\(\d+\) {name}\b", p, re.M))


@pytest.fixture(scope="module")
def hist(spark):
    return history_from_tables(spark, SF001)


def test_rank_final_plan(hist):
    p = plan(rank(hist))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert nodes(p, "BroadcastHashJoin") + nodes(p, "SortMergeJoin") <= 3   # the pairs' two frequencies, then the features
    assert "SortAggregate" not in p and "Window" not in p


def test_mode_frequency_is_hash_aggregated(hist):
    feats = response_features(hist)
    p = plan(fingerprint_frequency(feats, ["created_at", "id"], True))
    assert "HashAggregate" in p and "SortAggregate" not in p



def test_dataframe_simhash_moves_no_text(spark):
    """Tokens are counted per row and kept; what is shuffled after that is (row, token, count)."""
    d = read_table(spark, SF001, "documents").select("doc_id", "text")
    p = plan(simhash_frame(d, "text"))
    assert not {"text", "_x"} & moved(p) and moved(p)
    assert "SortAggregate" not in p and "documents.parquet" not in p


def test_filters_and_columns_reach_the_scan(spark):
    d = read_table(spark, SF001, "events").where("event_type = 'click'").select("event_id")
    p = plan(d)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in p
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in p


def test_summary_is_one_hash_aggregate(hist):
    p = plan(summary(response_features(hist)))
    assert nodes(p, "Expand") == 0 and "SortAggregate" not in p and nodes(p, "Exchange") <= 4


def moved(p: str) -> set[str]:
    """Columns below any exchange."""
    found = re.findall(r"^\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[([^\]]*)\]", p, re.M)
    return {c.split("#")[0].strip() for cols in found for c in cols.split(",")}


def test_no_body_is_moved_for_a_rank(spark):
    from pyspark.sql import functions as F

    from respscore.operators.features import measure_bodies
    from respscore.sources.history import fetch_by_ids

    h = history_from_tables(spark, SF001, bodies=False)
    ids = h.select("id", F.col("id").alias("pos"))
    raw = read_table(spark, SF001, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    for df in (response_features(h), response_features(h.withColumn("host", F.lit("h")), carry=["host"]),
               fetch_by_ids(measure_bodies(raw), ids)):
        p = plan(df)
        assert "hint" not in p.lower() and not {"text", "body", "_text"} & moved(p) and moved(p)


def test_newest_reads_bodies_once_and_filters_at_the_scan(spark):
    from pyspark.sql import functions as F

    h = history_from_tables(spark, SF001)
    p = plan(scan_history(h, limit=10, filter=F.col("body").contains("the")).select("id", "created_at"))
    assert p.count("documents.parquet") == 1
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", p)
    assert not {"text", "body"} & moved(p)
