"""History entry points: scan, filter, limit, ids, selection, paging, scope."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from respscore.functions.url import with_url_parts
from respscore.sources.history import (fetch_by_ids, keyset_page, page_cursor, resolve_filter,
                                       scan_history, scope_filter, selection_ids)
from respscore.sources.tables import history_from_tables


@pytest.fixture(scope="module")
def hist(spark):
    return history_from_tables(spark, SF001)


def test_limit_bounds(hist):
    for bad in (0, -5, "9"):
        with pytest.raises(ValueError):
            scan_history(hist, limit=bad)
    n = hist.count()
    assert scan_history(hist, limit=200000).count() == n
    assert scan_history(hist, limit=0, scan_all=True).count() == n   # the limit has no meaning then


def test_scan_newest_first(hist):
    got = {r.id for r in scan_history(hist, limit=7).collect()}
    want = {r.id for r in hist.orderBy(F.desc("created_at"), F.desc("id")).limit(7).collect()}
    assert got == want and len(got) == 7


def test_scan_all_ignores_limit(hist):
    assert scan_history(hist, limit=1, scan_all=True).count() == hist.count()


def test_blank_filter_is_identity(hist):
    assert resolve_filter("   ") is None and resolve_filter(None) is None
    assert scan_history(hist, scan_all=True, filter=" ").count() == hist.count()


def test_filter_string_column_and_preset(hist):
    a = scan_history(hist, scan_all=True, filter="method = 'POST' AND status_code = 302").count()
    b = scan_history(hist, scan_all=True, filter=(F.col("method") == "POST") & (F.col("status_code") == 302)).count()
    c = scan_history(hist, scan_all=True, filter="preset:redirects",
                     presets={"redirects": "status_code BETWEEN 300 AND 399"}).count()
    assert a == b > 0 and c >= a
    with pytest.raises(KeyError):
        scan_history(hist, filter="preset:nope")


def test_filter_fields_from_url(hist):
    h = with_url_parts(hist)
    n_https = h.where("scheme = 'https'").count()
    assert 0 < n_https < h.count()
    assert h.where("port = 443").count() == n_https
    assert h.where("host LIKE '%.example.%'").count() == h.count()


def test_fetch_by_ids_keeps_duplicates(spark, hist):
    ids = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (999999, 3)], "id long, pos long")
    got = sorted(r.id for r in fetch_by_ids(hist, ids).collect())
    assert got == [1, 1, 2]


def test_selection_first_seen(spark):
    main = spark.createDataFrame([(5, 0), (3, 1), (None, 2)], "id long, pos long")
    extra = spark.createDataFrame([(3, 0), (9, 1)], "id long, pos long")
    got = {r.id: (r.src, r.pos) for r in selection_ids(main, extra).collect()}
    assert got == {5: (0, 0), 3: (0, 1), 9: (1, 1)}


def test_selection_drops_empty_string_ids(spark):
    main = spark.createDataFrame([("", 0), ("a", 1)], "id string, pos long")
    assert [r.id for r in selection_ids(main).collect()] == ["a"]


def test_keyset_pages_partition_the_order(hist):
    p1 = keyset_page(hist, 300)
    p2 = keyset_page(hist, 300, after=page_cursor(p1))
    ids1 = [r.id for r in p1.collect()]
    ids2 = [r.id for r in p2.collect()]
    full = [r.id for r in hist.orderBy(F.desc("created_at"), F.desc("id")).limit(600).collect()]
    assert ids1 + ids2 == full


def test_scope_filter(spark, hist):
    scope = spark.createDataFrame([("NOPE.example.com",)], "host string")
    assert scope_filter(hist, scope).count() == 0
    one = hist.select(F.regexp_extract("url", "//([^/:?#]+)", 1).alias("host")).limit(1)
    assert scope_filter(hist, one).count() > 0


def test_header_and_body_predicates(spark):
    from respscore.functions.url import body_contains, header_contains
    from respscore.operators.features import response_features

    df = spark.createDataFrame(
        [(1, True, 200, {"content-type": ["Text/HTML; x=1", "ignored"], "x-a": ["1"]}, "hello there"),
         (2, True, 404, {"location": ["/next"]}, None)],
        "id long, has_response boolean, status_code int, headers map<string,array<string>>, body string")
    got = {r.id for r in df.where(header_contains("headers", "x-a: 1")).collect()}
    assert got == {1}
    assert {r.id for r in df.where(body_contains("body", "there")).collect()} == {1}
    f = {r.id: r for r in response_features(df, ["id"]).collect()}
    assert f[1].content_type == "text/html" and f[1].location is None
    assert f[2].content_type == "unknown" and f[2].location == "/next" and f[2].content_length == 0


def test_filter_fields_helper(hist):
    from respscore.sources.history import with_filter_fields

    h = with_filter_fields(hist)
    n = scan_history(h, scan_all=True, filter="length > 1000 AND scheme = 'https' AND method = 'GET'").count()
    m = h.where((F.col("length") > 1000) & (F.col("scheme") == "https") & (F.col("method") == "GET")).count()
    assert n == m > 0


def test_malformed_urls_do_not_throw(spark):
    from respscore.functions.url import with_url_parts

    df = spark.createDataFrame([("http://a b/%%%?q",), ("not a url",), ("",), (None,),
                                ("https://user@Host.Example:8443/p/x.JS#f",)], "url string")
    r = with_url_parts(df).collect()
    assert r[4].host == "host.example" and r[4].port == 8443 and r[4].ext == "js" and r[4].scheme == "https"
    assert r[1].host is None and r[1].scheme is None and r[1].path == "not a url"
    assert r[3].host is None and r[2].port is None


def test_validate_filter(hist):
    from respscore.sources.history import validate_filter

    assert validate_filter(hist, "  ") == {"valid": True, "error": None}
    assert validate_filter(hist, "status_code >= 400 AND method = 'GET'")["valid"]
    bad_col = validate_filter(hist, "no_such_column = 1")
    bad_syntax = validate_filter(hist, "status_code >>> AND")
    assert not bad_col["valid"] and bad_col["error"]
    assert not bad_syntax["valid"] and bad_syntax["error"]
    assert not validate_filter(hist, "preset:missing", presets={})["valid"]


def test_history_from_parts(spark):
    import datetime as dt

    from brute import brute_rank
    from respscore.plans.api import rank
    from respscore.sources.history import history_from_parts

    base = dt.datetime(2024, 1, 1)
    reqs = spark.createDataFrame(
        [("q1", base, "GET", "http://a/1", "p1"), ("q2", base - dt.timedelta(seconds=1), "POST", "http://a/2", None),
         ("q3", base - dt.timedelta(seconds=2), "GET", "http://a/3", "p3"),
         ("q4", base - dt.timedelta(seconds=3), "GET", "http://a/4", "p4")],
        "id string, created_at timestamp, method string, url string, response_id string")
    resps = spark.createDataFrame(
        [("p1", 200, {"content-type": ["text/html"]}, "ok page"), ("p3", 404, {}, "missing"),
         ("p4", 200, {"content-type": ["text/html"], "location": ["/x"]}, "ok page")],
        "id string, status_code int, headers map<string,array<string>>, body string")
    h = history_from_parts(reqs, resps)
    assert {r.id: r.has_response for r in h.collect()} == {"q1": True, "q2": False, "q3": True, "q4": True}
    got = [(r.id, r["rank"]) for r in rank(h).collect()]
    assert got == brute_rank([("q1", 200, "text/html", "ok page"), ("q3", 404, None, "missing"),
                              ("q4", 200, "text/html", "ok page")])
    assert {r.id: r.location for r in rank(h).collect()}["q4"] == "/x"


def test_newest_keeps_rows_without_timestamp(spark):
    import datetime as dt

    from respscore.sources.history import scan_history

    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 2)), (2, None), (3, dt.datetime(2024, 1, 1))],
                               "id long, created_at timestamp")
    assert sorted(r.id for r in scan_history(df, limit=3).collect()) == [1, 2, 3]
    assert sorted(r.id for r in scan_history(df, limit=2).collect()) == [1, 3]


def test_newest_never_overshoots_on_equal_keys(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1, 1, 2, 3, 456789)
    df = spark.createDataFrame([(1, t, "a"), (1, t, "b"), (1, t, "c"), (2, t, "d"), (0, None, "e")], "id long, created_at timestamp, x string")
    for kind in ("timestamp", "timestamp_ntz", "string"):
        rows = df.withColumn("created_at", F.col("created_at").cast(kind))
        for k in range(1, 7):
            got = scan_history(rows, limit=k).collect()
            assert len(got) == min(k, 5) and "d" in {r.x for r in got}
        assert {r.x for r in scan_history(rows, limit=1).collect()} == {"d"}


def test_filter_names(hist):
    from respscore.sources.history import with_filter_fields

    h = with_filter_fields(hist)
    assert scan_history(h, scan_all=True, filter="status >= 400 AND time > '2020-01-01'").count() == hist.where("status_code >= 400").count()
    assert set(hist.columns) < set(h.columns)


def test_errors_of_other_kinds_are_not_invalid_filters(hist):
    from respscore.sources.history import validate_filter

    with pytest.raises(AttributeError):
        validate_filter(None, "id = 1")
