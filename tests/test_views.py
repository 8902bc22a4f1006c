"""Result views (colour, high flag, user sort, slices, targets) and sinks."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from conftest import make_history
from respscore.operators.annotate import annotate, row_slice, targets, user_sort
from respscore.plans.api import rank
from respscore.sinks.export import (csv_projection, curl_command, export_csv, export_curl,
                                    export_urls, export_wordlist, wordlist)
from respscore.sinks.runs import (clear_runs, id_set_key, last_run, load_or_compute, load_run, run_index,
                                  run_summary, save_run, scan_key)

COLORS = [
    (500, "text/html", "red", "#a32f2a"), (600, "x", "red", "#a32f2a"), (404, "a", "amber", "#a06008"),
    (302, "a", "olive", "#8a7a06"), (200, "application/json", "green", "#157a37"),
    (200, "application/hal+json", "green", "#157a37"), (200, "text/xml", "blue", "#0b4ea8"),
    (200, "image/svg+xml", "none", "transparent"), (200, "application/xhtml+xml", "blue", "#0b4ea8"),
    (200, "text/html", "cyan", "#1f7aa8"), (200, "text/plain", "none", "transparent"),
    (100, "text/html", "none", "transparent"), (0, "application/json", "none", "transparent"),
]


def test_colours(spark):
    df = spark.createDataFrame([(s, t, 50) for s, t, _, _ in COLORS],
                               "status_code int, content_type string, rank int")
    got = [(r.category, r.color) for r in annotate(df).collect()]
    assert got == [(c, h) for _, _, c, h in COLORS]


def test_high_flag(spark):
    df = spark.createDataFrame([(200, "a", 70), (200, "a", 71)], "status_code int, content_type string, rank int")
    assert [r.is_high for r in annotate(df).collect()] == [False, True]


def test_user_sort_locale_and_stability(spark):
    rows = [("i1", 200, "t", "b"), ("i2", 200, "t", "B"), ("i3", 200, "t", "a"), ("i4", 200, "t", "A")]
    h = make_history(spark, rows).withColumn("method", F.col("body"))
    r = rank(h, sort=False)
    order = [F.col("rank").desc(), F.col("created_at").desc()]
    got = [x.method for x in user_sort(r, "method", "asc", order).collect()]
    assert got == ["a", "A", "b", "B"]
    got = [x.method for x in user_sort(r, "method", "desc", order).collect()]
    assert got == ["B", "b", "A", "a"]
    none = [x.id for x in user_sort(r, None, "none", order).collect()]
    assert none == [x.id for x in rank(h).collect()]
    with pytest.raises(ValueError):
        user_sort(r, "method", "sideways")


def test_row_slice(spark):
    df = spark.range(0, 100).orderBy("id")
    assert [r.id for r in row_slice(df, 10, 15).collect()] == [10, 11, 12, 13, 14]


def test_targets(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    sel = spark.createDataFrame([("b",), ("b",), ("zz",)], "id string")
    assert [r.id for r in targets(df, sel).collect()] == ["b"]
    assert targets(df, None).count() == 2


def test_csv_projection_and_file(spark, scratch):
    h = make_history(spark, [("a", 200, "text/html", "x y"), ("b", 404, None, "q")])
    r = rank(h)
    assert csv_projection(r).columns == ["Rank", "Method", "Status", "Length", "Type", "URL"]
    out = os.path.join(scratch, "csv")
    export_csv(r, out)
    lines = "".join(open(f).read() for f in sorted(glob.glob(out + "/part-*"))).splitlines()
    assert lines[0] == "Rank,Method,Status,Length,Type,URL" and len(lines) == 3


CRLF = "\r\n"


def test_curl(spark):
    df = spark.createDataFrame([
        (f"POST /x HTTP/1.1{CRLF}Host: a.com{CRLF}X-A: 1{CRLF}{CRLF}body", "http://a.com/x"),
        (f"GET / HTTP/1.1{CRLF}Host: b", "http://b/"),
        ("GET / HTTP/1.1", "http://c/"),
        (None, "http://d/"),
    ], "raw string, url string")
    got = [r.c for r in df.select(curl_command("raw", "url").alias("c")).collect()]
    assert got == ['curl -X POST -H "Host: a.com" -H "X-A: 1" "http://a.com/x"',
                   'curl -X GET -H "Host: b" "http://b/"',
                   'curl -X GET  "http://c/"',
                   None]


def test_file_sinks(spark, scratch):
    h = make_history(spark, [("a", 200, "text/html", "x"), ("b", 200, "text/html", "y")])
    r = rank(h)
    export_urls(r, os.path.join(scratch, "urls"))
    export_wordlist(r, os.path.join(scratch, "words"))
    req = spark.createDataFrame([("a", f"GET / HTTP/1.1{CRLF}Host: h{CRLF}{CRLF}"), ("b", "")], "id string, raw string")
    export_curl(r, req, os.path.join(scratch, "curl"))
    urls = sorted(spark.read.text(os.path.join(scratch, "urls")).collect())
    assert [u.value for u in urls] == ["http://h/a", "http://h/b"]
    curl = "".join(open(f).read() for f in glob.glob(os.path.join(scratch, "curl") + "/part-*"))
    assert curl.strip() == 'curl -X GET -H "Host: h" "http://h/a"'
    assert wordlist(r).count() == 2


def test_run_store(spark, scratch):
    h = make_history(spark, [("a", 200, "text/html", "x"), ("b", 404, "text/html", "y")])
    r = rank(h)
    path = os.path.join(scratch, "runs")
    assert last_run(spark, path).count() == 0 and load_run(spark, path, "k", r.schema).count() == 0
    assert run_index(spark, path).count() == 0
    k1, k2 = scan_key(500, False, " status_code >= 400 ", "v1"), scan_key(500, True, "x = 1 OR " * 60 + "y = 2")
    save_run(r, path, k1)
    save_run(r.limit(1), path, k2, 3.0)        # a key too long for a folder name
    save_run(r, path, k1, 12.5)                # replace k1 only
    assert load_run(spark, path, k1).count() == 2 and load_run(spark, path, k2).count() == 1
    assert load_run(spark, path, "none").count() == 0
    assert k1 == "scan:500:false:status_code >= 400:v1"
    assert last_run(spark, path).count() == 2          # k1 was saved last
    assert sorted(last_run(spark, path).columns) == sorted(r.columns)
    got = {x.run_key: (x.total_requests, x.duration_ms) for x in run_index(spark, path).collect()}
    assert got == {k1: (2, 12.5), k2: (1, 3.0)}
    clear_runs(spark, path)
    assert last_run(spark, path, r.schema).count() == 0 and load_run(spark, path, k1, r.schema).count() == 0
    save_run(r.limit(1), path, k2)                      # the store is usable after clearing
    assert load_run(spark, path, k2, r.schema).count() == 1 and last_run(spark, path, r.schema).count() == 1
    s = run_summary(r, 12.5).first()
    assert (s.total_requests, s.duration_ms) == (2, 12.5)


def test_load_or_compute_runs_once(spark, scratch):
    path, calls = os.path.join(scratch, "runs"), []

    def compute():
        calls.append(1)
        return rank(make_history(spark, [("a", 200, "text/html", "x")]))

    for _ in range(3):
        assert [x.id for x in load_or_compute(spark, path, "k", compute).collect()] == ["a"]
    assert len(calls) == 1


def test_exports_keep_rank_order_with_a_selection(spark, scratch):
    rows = [(f"r{i:02d}", [200, 404, 500][i % 3], "text/html", "word " * i) for i in range(40)]
    r = rank(make_history(spark, rows), sort=False).repartition(7)
    want = [x.url for x in rank(make_history(spark, rows)).collect() if x.id != "r05"]
    selection = r.select("id").where("id <> 'r05'")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        export_urls(r, os.path.join(scratch, "urls"), selection)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = "".join(open(f).read() for f in sorted(glob.glob(os.path.join(scratch, "urls") + "/part-*"))).splitlines()
    assert lines == want


def test_id_set_key_order_insensitive(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    b = spark.createDataFrame([(3,), (1,), (2,)], "id long")
    c = spark.createDataFrame([(3,), (1,)], "id long")
    ka, kb, kc = (id_set_key(x).first().run_key for x in (a, b, c))
    assert ka == kb != kc and ka.startswith("ids:")


def test_history_version_changes_with_new_traffic(spark):
    from respscore.sinks.runs import history_version

    h = make_history(spark, [("a", 200, "text/html", "x"), ("b", 200, "text/html", "y")])
    v1 = history_version(h.where("id = 'b'"))
    v2 = history_version(h)
    assert v1 != v2 and v2.startswith("2@")
    assert scan_key(500, False, None, v2).endswith(v2)


def test_history_version_changes_with_replaced_records(spark):
    from respscore.sinks.runs import history_version

    a = make_history(spark, [("a", 200, "text/html", "x"), ("b", 200, "text/html", "y")])
    b = make_history(spark, [("a", 404, "text/html", "x"), ("b", 200, "text/html", "y")])
    assert history_version(a) != history_version(b) and history_version(a) == history_version(a.repartition(3))
