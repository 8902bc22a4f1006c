"""What replaces single-task merges and whole-table work: distributed selection, late bodies, parts tables
without a shuffle, pruned mode, mergeable states, the token index and id-set digests."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from respscore.operators import annotate, profile, score, select, state
from respscore.operators.features import response_features
from respscore.plans import api
from respscore.session import materialize, release
from respscore.sinks import runs
from respscore.sources import history as H
from respscore.sources import tables, textindex
from test_plans import moved, nodes, plan

T0 = dt.datetime(2024, 5, 1)


def codes(spark, values):
    return spark.createDataFrame([(str(v),) for v in values], "c string").select(F.col("c").cast("decimal(38,0)").alias("c")).repartition(3)


@pytest.mark.parametrize("values", [
    [random.Random(1).randrange(-10 ** 35, 10 ** 35) for _ in range(400)],
    [random.Random(2).randrange(12) for _ in range(400)],
    [7] * 50, [10 ** k for k in range(36)] + [-10 ** k for k in range(36)], [5],
])
def test_kth_code_is_that_of_a_sort(spark, values):
    rows, order = codes(spark, values).cache(), sorted(values)
    for k in sorted({1, min(2, len(values)), len(values) // 3 or 1, len(values)}):
        for few in (1, 20):
            cut = select.kth_code(rows, "c", k, few=few, bins=4)
            assert (int(cut.code), cut.below, cut.equal) == (order[k - 1], sum(v < order[k - 1] for v in values), values.count(order[k - 1]))
    assert select.kth_code(rows, "c", len(values) + 1) is None
    rows.unpersist()


def test_codes_are_exact_in_the_last_digit(spark):
    """Keys of one time that differ by one: a DECIMAL of 35 digits must not be rounded when it is turned round."""
    rows = spark.range(25).select("id", F.lit(T0).alias("created_at"))
    for down in (False, True):
        got = [r.id for r in rows.select("id", select.order_code(rows, ["created_at", "id"], down).alias("c")).orderBy("c").collect()]
        assert got == sorted(range(25), reverse=down)
        assert rows.select(select.order_code(rows, ["created_at", "id"], down)).distinct().count() == 25


def keyed(spark, ids, seed=4, n=300):
    rng = random.Random(seed)
    rows = [(ids(rng), None if rng.random() < 0.1 else T0 + dt.timedelta(seconds=rng.randrange(20)), k) for k in range(n)]
    kind = "string" if isinstance(rows[0][0], str) else "bigint"
    return spark.createDataFrame(rows, f"id {kind}, created_at timestamp, k int").repartition(4)


@pytest.mark.parametrize("ids", [lambda r: r.randrange(10 ** 6), lambda r: r.randrange(5), lambda r: f"s{r.randrange(10 ** 6)}"])
def test_first_rows_are_those_of_a_limit(spark, ids):
    rows = keyed(spark, ids)
    for k in (1, 57, 150, 299, 300, 500):
        want = rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(k).select("created_at", "id").collect()
        got = select.first_rows(rows, ["created_at", "id"], True, k, few=3).select("created_at", "id").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_large_limit_has_no_single_task_merge(spark, monkeypatch):
    monkeypatch.setattr(H, "FEW", 10)
    monkeypatch.setattr(select, "FEW", 10)
    rows = keyed(spark, lambda r: r.randrange(10 ** 9))
    got = H.scan_history(rows, limit=200)
    p = plan(got)
    assert not re.search("TakeOrdered|GlobalLimit|Sort", p) and got.count() == 200
    small = rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(200)
    assert sorted(r.k for r in got.collect()) == sorted(r.k for r in small.collect())


def test_large_top_equals_the_ordered_prefix(spark):
    h = tables.history_from_tables(spark, SF001, bodies=False)
    ranked = api.rank(h, sort=False)
    want = [r.id for r in ranked.orderBy(*score.rank_order(["created_at", "id"], True)).collect()]
    for top in (1, 40, 111, 200, 900):
        got = score.top_rows(ranked, ["created_at", "id"], True, top, few=0)
        assert [r.id for r in got.collect()] == want[:top]
        assert not re.search("TakeOrdered|GlobalLimit", plan(got))
    assert api.rank(h, top=5).count() == 5


def test_deep_slices(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5).orderBy("v")
    for start, end in ((0, 5), (880, 930), (995, 2000), (1500, 1600), (400, 400), (0, 1000), (-5, 3)):
        got = annotate.deep_slice(rows, max(start, 0), end, "table")
        assert [r.v for r in got.collect()] == list(range(1000))[max(start, 0):end]
    p = plan(annotate.deep_slice(rows, 880, 930, "table"))
    assert "Limit" not in p and re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(_at", p)
    assert [r.v for r in annotate.row_slice(rows, 10, 13).collect()] == [10, 11, 12]


def test_few_records_are_ranked_without_reading_all_bodies(spark):
    h, bodies = tables.history_from_tables(spark, SF001, bodies=None), tables.document_bodies(spark, SF001)
    kw = {"limit": 30, "filter": "has_response AND method = 'GET'"}
    late = api.scan_and_rank(h, bodies=bodies, **kw)
    whole = api.scan_and_rank(tables.history_from_tables(spark, SF001), **kw)
    assert sorted(map(str, late.collect())) == sorted(map(str, whole.collect()))
    chosen = H.scan_history(h, **kw)
    p = plan(H.attach_bodies(chosen, bodies))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(doc_id", p)
    udf, semi = p.index("ArrowEvalPython"), p.index("LeftSemi")
    assert udf < semi and not {"text", "body", "_body", "_text"} & moved(p)  # measured above the semi-join, moved never


def test_late_bodies_of_nulls_repeats_and_nothing(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (9, "e")], "id long, x string")
    bodies = spark.createDataFrame([(1, "one two"), (2, None), (3, "three"), (None, "none")], "id long, body string")
    got = {r.x: (r.content_length, r.fingerprint != 0) for r in H.attach_bodies(rows, bodies).collect()}
    assert got == {"a": (7, True), "b": (7, True), "c": (0, False), "d": (0, False), "e": (0, False)}
    assert H.attach_bodies(rows.limit(0), bodies).count() == 0


def test_late_id_lists(spark):
    h = tables.history_from_tables(spark, SF001)
    ids = h.select("id").where("id % 3 = 0").select("id", F.col("id").alias("pos"))
    ids = ids.unionByName(ids.limit(4).select("id", (F.col("pos") + 10 ** 6).alias("pos")))
    late = api.rank_ids(tables.history_from_tables(spark, SF001, bodies=None), ids, order=["pos"], bodies=tables.document_bodies(spark, SF001))
    assert sorted(map(str, late.collect())) == sorted(map(str, api.rank_ids(h, ids, order=["pos"]).collect()))


def test_parts_hold_every_record_and_move_no_body(spark):
    requests, responses = tables.request_parts(spark, SF001)
    joined = H.history_from_parts(requests, responses)
    whole = tables.history_from_tables(spark, SF001)
    assert joined.where("has_response").count() == whole.where("has_response").count()
    p = plan(response_features(joined))
    assert not {"text", "body", "_text"} & moved(p) and moved(p)


def test_bucketed_parts_join_without_a_shuffle(spark, scratch):
    requests, responses = tables.request_parts(spark, SF001)
    requests = requests.unionByName(requests.limit(5).withColumns({"id": F.col("id") + 10 ** 6, "response_id": F.lit(None).cast("long")}))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    H.bucket_parts(requests, responses, scratch, "parts_test", 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        stored = H.bucketed_history(spark, "parts_test")
        p = plan(stored)
        assert nodes(p, "SortMergeJoin") == 1 and "Exchange" not in p
        want = H.history_from_parts(requests, responses)
        assert sorted(map(str, stored.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        H.drop_bucketed(spark, "parts_test")


@pytest.mark.parametrize("prints", [[5] * 40 + list(range(100)), [5, 6] * 20 + list(range(100)), list(range(150)), [], [3]])
def test_pruned_mode_is_the_mode(spark, prints):
    rows = spark.createDataFrame([(f, k) for k, f in enumerate(prints)], "fingerprint long, id long")
    for buckets, most in ((8, 3), (1 << 16, 512), (4, 1)):
        got = profile.mode_centroid_value(profile.mode_candidates(rows, buckets, most), ["id"], False)
        assert got == profile.mode_centroid_value(rows, ["id"], False)


def test_pruning_counts_few_rows_when_one_fingerprint_is_hot(spark):
    rows = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("fingerprint"), "id")
    assert profile.mode_candidates(rows).count() < 10100


def test_states_merge_to_the_whole_in_any_order(spark, scratch):
    feats = response_features(tables.history_from_tables(spark, SF001, bodies=False)).cache()
    parts = [state.profile_state(feats.where(f"id % 3 = {k}")) for k in range(3)]
    whole = profile.collect_stats(feats, ["created_at", "id"], True)
    for order in ((0, 1, 2), (2, 0, 1)):
        assert state.state_stats(state.merge_states(*[parts[k] for k in order])) == whole
    nested = state.merge_states(state.empty_state(spark), state.merge_states(parts[1], parts[2]), parts[0])
    state.save_state(nested, f"{scratch}/s")
    back = state.load_state(spark, f"{scratch}/s")
    assert state.state_stats(back) == whole
    assert state.state_profile(back).first() == profile.profile_frame(feats, ["created_at", "id"], True).first()
    assert state.state_stats(state.empty_state(spark)).n == 0 and state.state_profile(state.empty_state(spark)).count() == 0
    feats.unpersist()


def test_new_records_are_scored_as_a_full_run_scores_them(spark):
    h = tables.history_from_tables(spark, SF001, bodies=False)
    feats = response_features(h)
    old, new = feats.where("id % 4 <> 0"), feats.where("id % 4 = 0")
    got, grown = state.score_grown(new, state.profile_state(old))
    full = {r.id: r["rank"] for r in api.rank(h, sort=False).collect()}
    assert {r.id: r["rank"] for r in got.collect()} == {i: r for i, r in full.items() if i % 4 == 0}
    assert state.state_stats(grown).n == len(full)


def test_state_needs_keys_that_pack(spark):
    rows = spark.createDataFrame([("a", T0, 1)], "id string, created_at timestamp, fingerprint long")
    with pytest.raises(ValueError):
        state.profile_state(rows)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    common = [(k, f"plain words number {k} of the File, caf\u00e9 \u0130x", k % 5) for k in range(200)]
    rare = [(900, "a zebrafish swims", 3), (901, "Zebra-Fish", 1), (902, None, 2), (903, "", 2), (904, "\u4e2d\u6587 \u2013 !", 4)]
    spark.createDataFrame(common + rare, "id int, body string, part int").repartitionByRange(5, "part").write.parquet(f"{root}/t")
    table = spark.read.parquet(f"{root}/t")
    textindex.build_index(table, f"{root}/i")
    return root, table


def test_index_loses_no_row(spark, indexed):
    root, table = indexed
    rows = table.collect()
    for needle in ("zebrafish", "ebraf", "a zeb", "fish swims", "Zebra-F", "words number 7", "umber 19 of the F", "caf\u00e9 \u0130", "\u4e2d", " \u2013 ", "", "nowhere", "the file"):
        got = textindex.search(table, f"{root}/i", needle).collect()
        assert sorted(map(str, got)) == sorted(str(r) for r in rows if r.body is not None and needle in r.body), needle


def test_index_reads_few_files_for_a_rare_word_and_files_it_does_not_know(spark, indexed):
    root, table = indexed
    n = len(table.inputFiles())
    assert n >= 3
    assert len(textindex.search_files(table, f"{root}/i", "zebrafish")) == 1
    assert len(textindex.search_files(table, f"{root}/i", "plain words")) == n and textindex.search_files(table, f"{root}/i", "nowhere") == []
    assert textindex.candidate_files(spark, f"{root}/i", " - ") is None
    grown = f"{root}/grown"
    table.write.parquet(grown)
    textindex.build_index(spark.read.parquet(grown), f"{root}/j")
    spark.createDataFrame([(999, "late zebrafish", 0)], "id int, body string, part int").write.mode("append").parquet(grown)
    again = spark.read.parquet(grown)
    assert sorted(r.id for r in textindex.search(again, f"{root}/j", "zebrafish").collect()) == [900, 999]


def test_digest_of_a_changed_selection(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    key = lambda d: runs.digest_key(d).first()["run_key"]
    whole = lambda *x: key(runs.id_digest(ids(*x)))
    base = runs.id_digest(ids("a", "b", "c"))
    assert key(base) == whole("c", "a", "b") != whole("a", "b", "c", "c")
    assert key(runs.combine_digests(base, added=runs.id_digest(ids("c", "d")))) == whole("a", "b", "c", "c", "d")
    assert key(runs.combine_digests(base, removed=runs.id_digest(ids("a")))) == whole("b", "c")
    assert key(runs.combine_digests(base, added=runs.id_digest(ids("d")), removed=runs.id_digest(ids("a", "b")))) == whole("c", "d")
    none = runs.id_digest(ids("x").limit(0))
    assert key(none) == key(runs.combine_digests(base, removed=base)) != whole("x")


def test_checkpoints_are_released(spark, scratch):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://").removeprefix("file:")
    count = lambda: sum(len(d) for r, d, _ in os.walk(folder) if r != folder and "respscore-" not in r)
    release()
    before = count()
    materialize(spark.range(10).selectExpr("id * 2 AS x"), "checkpoint").count()
    assert count() > before
    release()
    assert count() == before


def test_entry_without_a_package_of_the_optional_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__ as e\nassert 'rank_scan' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=annotate.__file__.rsplit("/respscore/", 1)[0])
