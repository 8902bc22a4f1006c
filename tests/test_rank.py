"""Full-rank vectors, tie rules, properties and edge cases."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF001, make_history
from respscore.functions.simhash import to_hex
from respscore.operators.features import response_features
from respscore.operators.profile import collect_stats
from respscore.plans.api import ids_from_list, rank, rank_ids

SIX = [
    ("r1", 200, "text/html; charset=utf-8", "<html><body>ok</body></html>"),
    ("r2", 200, "Text/HTML", "<html><body>ok</body></html>"),
    ("r3", 404, "application/json", '{"error":"not found"}'),
    ("r4", 500, "text/html", "<html><body>stack trace at line 42</body></html>"),
    ("r5", 302, None, ""),
    ("r6", 200, "text/html", "<html><body>ok</body></html>"),
]
SIX_RANK = {"r1": 15, "r2": 15, "r3": 54, "r4": 38, "r5": 67, "r6": 15}
SIX_ORDER = ["r5", "r3", "r4", "r1", "r2", "r6"]


def test_six_row_vector_scan_order(spark):
    h = make_history(spark, SIX)
    out = rank(h, details=True).collect()
    assert [r.id for r in out] == SIX_ORDER
    assert {r.id: r["rank"] for r in out} == SIX_RANK
    assert {r.id: r.hamming for r in out} == {"r1": 0, "r2": 0, "r3": 31, "r4": 12, "r5": 37, "r6": 0}
    st_ = collect_stats(response_features(h), ["created_at", "id"], True)
    assert st_.mean == 25.5 and abs(st_.sd - 14.115594213493104) < 1e-12
    assert to_hex(st_.centroid) == "8889f58f95cf7bb5"


def test_six_row_vector_id_list(spark):
    h = make_history(spark, SIX).drop("created_at")
    ids = ids_from_list(spark, [r[0] for r in SIX])
    out = rank_ids(h, ids).collect()
    assert [r.id for r in out] == SIX_ORDER
    assert {r.id: r["rank"] for r in out} == SIX_RANK


def test_result_fields(spark):
    r = {x.id: x for x in rank(make_history(spark, SIX)).collect()}
    assert r["r5"].content_type == "unknown" and r["r5"].content_length == 0
    assert r["r2"].content_type == "text/html" and r["r4"].status_code == 500
    assert r["r1"].method == "GET" and r["r1"].url == "http://h/r1" and r["r1"].location is None


def test_centroid_tie_first_to_reach(spark):
    rows = [("t1", 200, "a/b", "alpha"), ("t2", 200, "a/b", "beta"),
            ("t3", 200, "a/b", "beta"), ("t4", 200, "a/b", "alpha")]
    h = make_history(spark, rows)
    st_ = collect_stats(response_features(h), ["created_at", "id"], True)
    assert to_hex(st_.centroid) == "7627619b954620a7"
    out = rank(h, details=True).collect()
    assert [(r.id, r["rank"], r.hamming) for r in out] == [
        ("t1", 23, 22), ("t4", 23, 22), ("t2", 6, 0), ("t3", 6, 0)]
    # the same list given as ids in ascending position order
    ids = ids_from_list(spark, ["t1", "t2", "t3", "t4"])
    out2 = rank_ids(h.drop("created_at"), ids).collect()
    assert [(r.id, r["rank"]) for r in out2] == [("t1", 23), ("t4", 23), ("t2", 6), ("t3", 6)]


def test_struct_fallback_centroid_matches_packed(spark):
    """Order keys that cannot be packed (string, string) use a struct aggregate."""
    rows = [("t1", 200, "a/b", "alpha"), ("t2", 200, "a/b", "beta"),
            ("t3", 200, "a/b", "beta"), ("t4", 200, "a/b", "alpha")]
    h = make_history(spark, rows).withColumn("k1", F.lit("x")).withColumn("k2", F.col("id"))
    st_ = collect_stats(response_features(h, ["k1", "k2"]), ["k1", "k2"], False)
    assert to_hex(st_.centroid) == "7627619b954620a7"


def test_duplicate_ids_are_ranked_twice(spark):
    h = make_history(spark, SIX).drop("created_at")
    ids = ids_from_list(spark, ["r1", "r3", "r1", "missing"])
    out = rank_ids(h, ids).collect()
    assert sorted(r.id for r in out) == ["r1", "r1", "r3"]


def test_empty_input(spark):
    h = make_history(spark, SIX).where("false")
    assert rank(h).count() == 0


def test_no_response_dropped_before_stats(spark):
    h = make_history(spark, SIX).withColumn("has_response", F.col("id") != "r5")
    out = {r.id: r["rank"] for r in rank(h).collect()}
    assert "r5" not in out and len(out) == 5


def test_single_row_rank_zero(spark):
    out = rank(make_history(spark, SIX[:1])).collect()
    assert [r["rank"] for r in out] == [0]


def test_identical_rows_rank_zero(spark):
    rows = [(f"x{i}", 200, "text/html", "same body") for i in range(5)]
    assert {r["rank"] for r in rank(make_history(spark, rows)).collect()} == {0}


@settings(max_examples=3, deadline=None)
@given(st.permutations(list(range(6))))
def test_row_permutation_invariance(spark, perm):
    h = make_history(spark, SIX)
    shuffled = spark.createDataFrame([h.collect()[i] for i in perm], h.schema)
    assert [tuple(r) for r in rank(shuffled).collect()] == [tuple(r) for r in rank(h).collect()]


def test_materialize_modes_agree(spark):
    h = make_history(spark, SIX)
    a = [tuple(r) for r in rank(h, materialize_how="checkpoint").collect()]
    b = [tuple(r) for r in rank(h, materialize_how="persist").collect()]
    c = [tuple(r) for r in rank(h, materialize_how="none").collect()]
    d = [tuple(r) for r in rank(h, materialize_how="table").collect()]
    assert a == b == c == d


def test_golden_sf0001(spark):
    from respscore.sources.tables import history_from_tables

    h = history_from_tables(spark, SF001)
    out = rank(h, details=True).collect()
    assert len(out) == 200
    ranks = [r["rank"] for r in out]
    assert (min(ranks), max(ranks)) == (27, 62)
    assert [sum(1 for v in ranks if v // 10 == d) for d in (2, 3, 4, 5, 6)] == [5, 67, 106, 21, 1]
    first = [(r.id, r["rank"], r.content_length, r.content_type, r.fingerprint, r.hamming) for r in out[:3]]
    assert first == [(71, 62, 13393, "application/xhtml+xml", "888a2619b5695272", 21),
                     (116, 59, 9329, "image/svg+xml", "889e2719b5695278", 22),
                     (132, 55, 33, "image/svg+xml", "2e22f152a7be967f", 28)]
    st_ = collect_stats(response_features(h), ["created_at", "id"], True)
    assert (st_.n, st_.mean) == (200, 2479.46)
    assert to_hex(st_.centroid) == "08a25707b54b2461"


def test_native_and_udf_rank_agree(spark):
    from respscore.sources.tables import history_from_tables

    h = history_from_tables(spark, SF001)
    a = [tuple(r) for r in rank(h, fingerprint="udf").collect()]
    b = [tuple(r) for r in rank(h, fingerprint="frame").collect()]
    assert a == b


def test_rank_bounds(spark):
    from respscore.sources.tables import pages_history

    out = rank(pages_history(spark, SF001), order=["id"], descending=False).collect()
    assert all(0 <= r["rank"] <= 100 for r in out) and len(out) == 50


def test_unknown_options_raise(spark):
    h = make_history(spark, SIX)
    with pytest.raises(ValueError):
        rank(h, centroid="mean").collect()
    with pytest.raises(ValueError):
        rank(h, fingerprint="other").collect()


def test_rank_ids_requires_position(spark):
    h = make_history(spark, SIX)
    with pytest.raises(ValueError):
        rank_ids(h, spark.createDataFrame([("r1",)], "id string"))


def test_created_at_ties_broken_by_id(spark):
    """Equal timestamps: ties in rank keep newest-first order, i.e. id descending."""
    from conftest import HISTORY_SCHEMA

    base = dt.datetime(2024, 1, 1)
    data = [(f"z{i}", base, "GET", "u", True, 200, "text/html", None, "same") for i in range(4)]
    out = rank(spark.createDataFrame(data, HISTORY_SCHEMA)).collect()
    assert [r.id for r in out] == ["z3", "z2", "z1", "z0"]


def test_rank_by_constant_group_equals_rank(spark):
    from respscore.operators.grouped import rank_by
    from respscore.sources.tables import history_from_tables

    h = history_from_tables(spark, SF001)
    a = {r.id: r["rank"] for r in rank(h).collect()}
    g = h.withColumn("g", F.lit("all"))
    b = {r.id: r["rank"] for r in rank_by(g, ["g"]).collect()}
    m = {r.id: r["rank"] for r in rank_by(g, ["g"], centroid="majority").collect()}
    am = {r.id: r["rank"] for r in rank(h, centroid="majority").collect()}
    assert a == b and m == am


def test_rank_by_groups_are_independent(spark):
    from respscore.operators.grouped import rank_by

    h = make_history(spark, SIX).withColumn("g", F.lit(None).cast("string"))
    t = make_history(spark, [("t1", 200, "a/b", "alpha"), ("t2", 200, "a/b", "beta"),
                             ("t3", 200, "a/b", "beta"), ("t4", 200, "a/b", "alpha")]).withColumn("g", F.lit("tie"))
    out = rank_by(h.unionByName(t), ["g"]).collect()
    got = {r.id: r["rank"] for r in out}
    assert {k: got[k] for k in SIX_RANK} == SIX_RANK          # null group key is a group too
    assert [got[k] for k in ("t1", "t2", "t3", "t4")] == [23, 6, 6, 23]
    assert [r.id for r in out][:6] == SIX_ORDER                 # nulls first, rank order inside



def test_mode_centroid_value_string_ids(spark):
    """STRING ids: leading key packed, exact tie-break on the rest."""
    from respscore.operators.profile import mode_centroid, mode_centroid_value

    base = dt.datetime(2024, 1, 1)
    from conftest import HISTORY_SCHEMA
    # same created_at for all: the tie on (count, last created_at) must be broken by id
    for ids in (["a", "b", "c", "d"], ["d", "c", "b", "a"], ["b", "a", "d", "c"]):
        bodies = ["alpha", "beta", "beta", "alpha"]
        data = [(i, base, "GET", "u", True, 200, "t/t", None, b) for i, b in zip(ids, bodies)]
        feats = response_features(spark.createDataFrame(data, HISTORY_SCHEMA))
        for desc in (True, False):
            fast = mode_centroid_value(feats, ["created_at", "id"], desc)
            slow = int(mode_centroid(feats, ["created_at", "id"], desc).first()["centroid"])
            assert fast == slow
    # distinct timestamps: resolved by the leading key alone
    rows = [("t1", 200, "a/b", "alpha"), ("t2", 200, "a/b", "beta"),
            ("t3", 200, "a/b", "beta"), ("t4", 200, "a/b", "alpha")]
    feats = response_features(make_history(spark, rows))
    assert to_hex(mode_centroid_value(feats, ["created_at", "id"], True)) == "7627619b954620a7"


def test_wide_form_binary_bodies_rank_like_canonical(spark):
    """MAP<STRING, ARRAY<STRING>> headers and BINARY bodies rank like the
    canonical columns they encode."""
    from brute import brute_rank

    rows = [("w1", 200, "text/html; charset=utf-8", "<html>ok</html>"),
            ("w2", 200, None, "<html>ok</html>"),
            ("w3", 404, "application/json", '{"e": 1} é'),
            ("w4", 500, "text/html", "trace at line 9")]
    base = dt.datetime(2024, 1, 1)
    data = [(rid, base - dt.timedelta(seconds=i), "GET", f"http://h/{rid}", True, st,
             ({"content-type": [ct, "ignored"]} if ct else {"x-other": ["1"]}), bytearray(body.encode("utf-8")))
            for i, (rid, st, ct, body) in enumerate(rows)]
    wide = spark.createDataFrame(data, "id string, created_at timestamp, method string, url string, "
                                       "has_response boolean, status_code int, "
                                       "headers map<string,array<string>>, body binary")
    got = [(r.id, r["rank"]) for r in rank(wide).collect()]
    assert got == brute_rank(rows)
    lengths = {r.id: r.content_length for r in rank(wide).collect()}
    assert lengths["w3"] == len('{"e": 1} é'.encode("utf-8"))


def test_group_mode_lead_path_matches_struct_path(spark):
    from respscore.operators.grouped import _group_mode_struct, group_mode_centroid
    from conftest import HISTORY_SCHEMA

    base = dt.datetime(2024, 1, 1)
    data = []
    # group a: tie on count and on created_at, broken by id; group b: no tie;
    # group c: tie on count only (distinct created_at)
    for i, (g, body, sec, rid) in enumerate([
            ("a", "alpha", 0, "a1"), ("a", "beta", 0, "a2"), ("a", "beta", 0, "a3"), ("a", "alpha", 0, "a4"),
            ("b", "x", 1, "b1"), ("b", "x", 2, "b2"), ("b", "y", 3, "b3"),
            ("c", "p", 1, "c1"), ("c", "q", 2, "c2"), ("c", "q", 3, "c3"), ("c", "p", 4, "c4")]):
        data.append((rid, base - dt.timedelta(seconds=sec), "GET", g, True, 200, "t/t", None, body))
    feats = response_features(spark.createDataFrame(data, HISTORY_SCHEMA), carry=["url"])
    for desc in (True, False):
        fast = {r.url: r.centroid for r in group_mode_centroid(feats, ["url"], ["created_at", "id"], desc).collect()}
        slow = {r.url: r.centroid for r in _group_mode_struct(feats, ["url"], ["created_at", "id"], desc).collect()}
        assert fast == slow and len(fast) == 3


def test_rank_by_a_result_column(spark):
    from respscore.operators.grouped import rank_by
    from respscore.sources.tables import history_from_tables

    out = rank_by(history_from_tables(spark, SF001), ["url"])
    assert out.columns.count("url") == 1 and out.count() == 200



def test_rank_exactly_half_rounds_up(spark):
    """(stat*0.5 + sim*0.5)*100 == 12.5 exactly for r0: JS Math.round gives 13."""
    from brute import brute_rank

    rows = [("r0", 500, "application/json", "a"), ("r1", 200, "text/html", "a"),
            ("r2", 500, "text/html", ""), ("r3", 500, "application/json", "ab")]
    got = {r.id: r["rank"] for r in rank(make_history(spark, rows)).collect()}
    assert got["r0"] == 13
    assert sorted(got.items()) == sorted(brute_rank(rows))


def test_grouped_details_match_single_group(spark):
    from respscore.operators.grouped import rank_by

    h = make_history(spark, SIX)
    a = {r.id: (r.fingerprint, r.hamming) for r in rank(h, details=True).collect()}
    b = {r.id: (r.fingerprint, r.hamming) for r in rank_by(h.withColumn("g", F.lit(1)), ["g"], details=True).collect()}
    assert a == b


def test_rank_ids_few_and_measured_agree(spark):
    from respscore.operators.features import measure_bodies

    h = make_history(spark, SIX).drop("created_at")
    ids = ids_from_list(spark, [r[0] for r in SIX] + ["r1"])
    want = [tuple(r) for r in rank_ids(h, ids).collect()]
    assert len(want) == 7
    assert [tuple(r) for r in rank_ids(h, ids, few=True).collect()] == want
    assert [tuple(r) for r in rank_ids(measure_bodies(h), ids).collect()] == want


def test_shuffle_joins_give_the_same(spark):
    """With Spark's own broadcast threshold at zero, every join shuffles."""
    from respscore.sources.history import scope_filter
    from respscore.sources.tables import history_from_tables

    def run():
        h = history_from_tables(spark, SF001)
        g = h.withColumn("g", F.col("status_code") % 3)
        scope = h.select(F.regexp_extract("url", "//([^/:?#]+)", 1).alias("host")).limit(3)
        ids = h.where("has_response").select("id", F.col("id").alias("pos"))
        return ([tuple(r) for r in rank(h).collect()], [tuple(r) for r in rank(g, by=["g"]).collect()],
                sorted(r.id for r in scope_filter(h, scope).collect()), [tuple(r) for r in rank_ids(h, ids).collect()])

    before = run()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("column", ["status_code", "content_type", "method"])
def test_rank_by_any_result_column(spark, column):
    from brute import brute_rank

    h = make_history(spark, SIX)
    out = rank(h, by=[column]).collect()
    groups = {}
    for r in out:
        groups.setdefault(r[column], []).append((r.id, r["rank"]))
    for got in groups.values():
        assert got == brute_rank([row for row in SIX if row[0] in dict(got)])
    assert sum(map(len, groups.values())) == 6


def test_rank_by_with_top(spark):
    h = make_history(spark, SIX).withColumn("g", F.col("id") > "r3")
    every = sorted(rank(h, by=["g"]).collect(), key=lambda r: -r["rank"])
    top = rank(h, by=["g"], top=2).collect()
    assert [r["rank"] for r in top] == [r["rank"] for r in every[:2]]


@pytest.mark.parametrize("id_type", ["string", "long"])
def test_mode_tie_with_null_timestamps(spark, id_type):
    """A null created_at is oldest: the last in a newest-first input."""
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base, "alpha"), (2, None, "alpha"), (3, base - dt.timedelta(days=1), "beta"), (4, base - dt.timedelta(days=2), "beta")]
    data = [(str(i) if id_type == "string" else i, t, True, 200, b) for i, t, b in rows]
    h = spark.createDataFrame(data, f"id {id_type}, created_at timestamp, has_response boolean, status_code int, body string")
    for by in (None, ["status_code"]):
        got = {str(r.id): r.hamming for r in rank(h, by=by, details=True).collect()}
        assert got["3"] == got["4"] == 0 and got["1"] > 0  # beta is whole before alpha's last


def test_whole_bodies_count(spark):
    long_ = "word " * 20000
    h = make_history(spark, [("a", 200, "t", long_ + "one two three"), ("b", 200, "t", long_ + "four five six"), ("c", 200, "t", "x")])
    whole = {r.id: r.fingerprint for r in rank(h, details=True).collect()}
    cut_ = {r.id: r.fingerprint for r in rank(h, details=True, max_body_units=51200).collect()}
    assert cut_["a"] == cut_["b"] and set(whole) == set(cut_)
    from respscore.functions.simhash import simhash_texts
    assert whole["a"] == to_hex(simhash_texts([long_ + "one two three"])[0])


def test_equal_rows_stay_in_the_frame_plan(spark):
    h = make_history(spark, SIX)
    twice = h.unionByName(h)
    a = sorted(map(str, rank(twice, fingerprint="frame").collect()))
    assert len(a) == 12 and a == sorted(map(str, rank(twice).collect()))


def test_header_names_match_in_any_case(spark):
    data = [(1, True, 200, {"Content-Type": ["Text/HTML; q"], "LOCATION": ["/n"]}, "x")]
    h = spark.createDataFrame(data, "id long, has_response boolean, status_code int, headers map<string,array<string>>, body string")
    r = rank(h, order=["id"]).first()
    assert (r.content_type, r.location) == ("text/html", "/n")
