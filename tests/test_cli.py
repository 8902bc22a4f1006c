"""Command-line entry (run in-process on the test session)."""

import os

from conftest import SF001
from pyspark.sql import functions as F

from respscore.__main__ import main
from respscore.sinks.runs import load_run, run_index


def test_cli_scan_csv_and_parquet(spark, scratch):
    out = os.path.join(scratch, "csv")
    main(["scan", "--tables", SF001, "--limit", "300", "--filter", "has_response", "--out", out,
          "--format", "csv"])
    rows = spark.read.option("header", True).csv(out).collect()
    assert 0 < len(rows) <= 300 and set(rows[0].asDict()) == {"Rank", "Method", "Status", "Length", "Type", "URL"}
    pq = os.path.join(scratch, "pq")
    main(["scan", "--tables", SF001, "--all", "--top", "5", "--out", pq])
    got = spark.read.parquet(pq)
    assert got.count() == 5 and "category" in got.columns


def test_cli_ids_and_runs(spark, scratch):
    ids = os.path.join(scratch, "ids")
    spark.read.parquet(f"{SF001}/labels.parquet").selectExpr("doc_id AS id", "doc_id AS pos") \
        .write.parquet(ids)
    runs = os.path.join(scratch, "runs")
    main(["ids", "--tables", SF001, "--ids", ids, "--out", runs, "--run-key", "k1"])
    assert load_run(spark, runs, "k1").count() > 0
    by = os.path.join(scratch, "by")
    main(["ids", "--tables", SF001, "--ids", ids, "--by", "status_code", "--top", "3", "--out", by])
    assert spark.read.parquet(by).count() == 3


def test_cli_curl_writes_the_requests_own_text(spark, scratch):
    import pytest

    from conftest import make_history

    raw = "PUT /real HTTP/1.1\r\nHost: h\r\nCookie: s=1\r\n\r\nbody"
    h = make_history(spark, [("a", 200, "text/html", "x"), ("b", 404, None, "y")]).withColumn("url", F.lit("/relative"))
    path, out = os.path.join(scratch, "hist"), os.path.join(scratch, "curl")
    h.withColumn("raw", F.when(F.col("id") == "a", raw)).write.parquet(path)
    main(["scan", "--history", path, "--out", out, "--format", "curl"])
    assert [r.value for r in spark.read.text(out).where("value <> ''").collect()] == ['curl -X PUT -H "Host: h" -H "Cookie: s=1" "/relative"']
    with pytest.raises(SystemExit):
        main(["scan", "--tables", SF001, "--out", out, "--format", "curl"])


def test_cli_auto_run_key(spark, scratch):
    runs = os.path.join(scratch, "auto")
    main(["scan", "--tables", SF001, "--limit", "100", "--filter", "has_response", "--out", runs,
          "--run-key", "auto"])
    main(["scan", "--tables", SF001, "--limit", "100", "--filter", "has_response", "--out", runs,
          "--run-key", "auto"])
    index = run_index(spark, runs).collect()   # the second call found the stored run
    assert len(index) == 1 and index[0].run_key.startswith("scan:100:false:has_response:")
    assert index[0].total_requests == 100 and index[0].duration_ms > 0
