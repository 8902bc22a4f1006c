"""Registered queries: one builder per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or the history views Spark derives
from them) in full; the DuckDB twin of each lives in ``plans.oracle``.
Column names match the oracle exactly.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.simhash import fnv1a64_col, simhash64, simhash_frame
from ..functions.text import fingerprint_hex, mime_type, tokens
from ..functions.url import (body_contains, header_contains, path_ext, url_host, url_path, url_port, url_query,
                             url_scheme)
from ..operators.annotate import annotate, row_slice, targets, user_sort
from ..operators.features import response_features
from ..operators.grouped import rank_by
from ..operators.joins import key_join
from ..operators.profile import (collect_stats, frequencies_of, length_moments, majority_centroid,
                                 mode_centroid, moments_of, profile_frame, sigma, status_frequency,
                                 summary, type_frequency)
from ..operators.score import rank_order, score_columns
from ..operators.state import load_state, merge_states, profile_state, save_state, state_profile
from ..session import configured_checkpoint_dir, materialize
from ..sinks.export import csv_projection, curl_lines, in_rank_order, wordlist
from ..sinks.runs import (combine_digests, digest_key, id_digest, id_set_key, last_run, load_or_compute, run_index,
                          run_summary)
from ..sources.history import (SCAN_ORDER, history_from_parts, keyset_page, page_cursor, scan_history,
                               scope_filter, selection_ids, with_filter_fields)
from ..sources.tables import (document_bodies, history_from_tables, pages_history, read_table, request_parts,
                              requests_with_raw)
from ..sources.textindex import build_index, search
from .api import rank, rank_ids

Builder = Callable[[SparkSession, str], DataFrame]
SCAN = list(SCAN_ORDER)


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return history_from_tables(spark, sf)


def _measured(spark: SparkSession, sf: str, fingerprint: str = "udf") -> DataFrame:
    """The history with bodies measured before the joins."""
    return history_from_tables(spark, sf, bodies=False, fingerprint=fingerprint)


def _feats(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(response_features(_measured(spark, sf), SCAN))


def stored_dir(spark: SparkSession) -> str:
    """Where a query keeps a run: the shared folder the session names (a local one only in local mode)."""
    named = configured_checkpoint_dir(spark)
    if not named and not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or tempfile.mkdtemp(prefix="respscore-runs-")).rstrip("/")


def _label_lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two ordered id lists from ``labels``: good-quality docs, toxic docs."""
    lab = read_table(spark, sf, "labels")
    main = lab.where(F.col("quality") == 1).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"))
    extra = lab.where(F.col("toxic") == 1).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"))
    return main, extra


# ------------------------------------------------------------ scans / sources
def q_scan_recent(spark, sf):
    return scan_history(_history(spark, sf)).select("id", "created_at", "method", "url", "status_code")


def q_scan_filtered(spark, sf):
    rows = scan_history(_history(spark, sf), scan_all=True, filter="method = 'POST' AND status_code = 302")
    return rows.select("id", "created_at", "url", "location")


def q_scan_limit(spark, sf):
    rows = scan_history(_history(spark, sf), limit=1000, filter=F.col("status_code") >= 400)
    return rows.select("id", "created_at", "status_code")


def q_scan_body_filter(spark, sf):
    """F1 ``body:`` predicate: the 200 newest responses whose body holds a word."""
    rows = scan_history(_history(spark, sf), limit=200,
                        filter=body_contains("body", "the") & F.col("has_response"))
    return rows.select("id", "created_at", "status_code")


def q_keyset_page(spark, sf):
    h = _history(spark, sf)
    first = keyset_page(h, 1000)
    return keyset_page(h, 1000, after=page_cursor(first)).select("id", "created_at")


def q_selection_union(spark, sf):
    main, extra = _label_lists(spark, sf)
    return selection_ids(main, extra)


def q_scope_filter(spark, sf):
    scope = read_table(spark, sf, "pages").where(F.col("url").startswith("https://")) \
        .select(url_host("url").alias("host"))
    return scope_filter(_history(spark, sf), scope).select("id", "url")


def q_url_parts(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", url_scheme("url").alias("scheme"), url_host("url").alias("host"),
                    url_port("url").alias("port"), url_path("url").alias("path"),
                    url_query("url").alias("query"), path_ext(url_path("url")).alias("ext"))


# ------------------------------------------------- filters / functions
def q_drop_no_response(spark, sf):
    f = response_features(_measured(spark, sf), SCAN)
    return f.select("id", "method", "status_code", "content_length")


def q_mime_normalise(spark, sf):
    h = _history(spark, sf)
    return (h.groupBy("content_type_header")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("content_type_header", mime_type("content_type_header").alias("content_type"), "n"))


def _documents(spark, sf):
    return read_table(spark, sf, "documents")


def q_tokens(spark, sf):
    d = _documents(spark, sf)
    t = tokens("text")
    return d.select("doc_id", F.size(t).cast("bigint").alias("n_tokens"),
                    F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


def q_fnv64(spark, sf):
    d = _documents(spark, sf)
    words = d.select(F.explode(tokens("text")).alias("token")).distinct()
    return words.select("token", fingerprint_hex(fnv1a64_col("token")).alias("fnv"))


def q_simhash_udf(spark, sf):
    d = _documents(spark, sf)
    return d.select("doc_id", fingerprint_hex(simhash64("text")).alias("fingerprint"))


def q_simhash_native(spark, sf):
    d = _documents(spark, sf).select("doc_id", "text")
    return simhash_frame(d, "text").select("doc_id", fingerprint_hex("fingerprint").alias("fingerprint"))


# ------------------------------------------------------------ aggregates
def q_status_freq(spark, sf):
    return status_frequency(response_features(_measured(spark, sf), SCAN))


def q_type_freq(spark, sf):
    return type_frequency(response_features(_measured(spark, sf), SCAN))


def q_length_stats(spark, sf):
    m = length_moments(response_features(_measured(spark, sf), SCAN))
    return m.select("n", F.col("sum_length").cast("bigint").alias("sum_length"),
                    (F.col("sum_length").cast("double") / F.col("n")).alias("mean_length"),
                    sigma("n", "sum_length", "sum_length_sq").alias("sd_length"))


def q_centroid_mode(spark, sf):
    c = mode_centroid(_feats(spark, sf), SCAN, True)
    return c.select(fingerprint_hex("centroid").alias("centroid"), "centroid_count")


def q_centroid_majority(spark, sf):
    return majority_centroid(_feats(spark, sf)).select(fingerprint_hex("centroid").alias("centroid"))


def q_profile(spark, sf):
    return profile_frame(_feats(spark, sf), SCAN, True)


# ------------------------------------------------------------ scoring parts
def _scored(spark, sf, centroid="mode"):
    feats = _feats(spark, sf)
    stats = collect_stats(feats, SCAN, True, centroid)
    sc = score_columns(stats)
    return feats, stats, sc


def q_hamming_to_centroid(spark, sf):
    feats, _, sc = _scored(spark, sf)
    return feats.select("id", fingerprint_hex("fingerprint").alias("fingerprint"), sc["hamming"].alias("hamming"))


def q_length_outlier(spark, sf):
    feats, _, sc = _scored(spark, sf)
    return feats.select("id", sc["length_outlier"].alias("length_outlier"))


def q_rarity(spark, sf):
    feats = _feats(spark, sf)
    summ = materialize(summary(feats))
    n = F.lit(moments_of(summ).first()["n"]).cast("bigint")
    j = key_join(feats, frequencies_of(summ), ["status_code", "content_type"])
    return j.select("id", (F.lit(1) - F.col("status_count") / n).alias("status_rarity"),
                    (F.lit(1) - F.col("type_count") / n).alias("type_rarity"))


# ------------------------------------------------------------ rank (R1-R3)
def q_rank_scan(spark, sf):
    return rank(_measured(spark, sf))


def q_rank_topk(spark, sf):
    return rank(_measured(spark, sf), top=25)


def q_rank_majority(spark, sf):
    return rank(_measured(spark, sf), centroid="majority")


def q_rank_native(spark, sf):
    return rank(_measured(spark, sf, "frame"))


def q_rank_pages(spark, sf):
    return rank(pages_history(spark, sf), order=["id"], descending=False)


def q_rank_ids(spark, sf):
    main, extra = _label_lists(spark, sf)
    ids = (main.select("id", F.lit(0).alias("src"), "pos")
           .unionByName(extra.select("id", F.lit(1).alias("src"), "pos")))
    return rank_ids(history_from_tables(spark, sf, bodies=None), ids, order=["src", "pos"], bodies=document_bodies(spark, sf))


def q_rank_scan_limit(spark, sf):
    from .api import scan_and_rank
    return scan_and_rank(history_from_tables(spark, sf, bodies=None), limit=300, filter="has_response AND method = 'GET'",
                         bodies=document_bodies(spark, sf))


def q_rank_by_host(spark, sf):
    h = _measured(spark, sf).withColumn("host", url_host("url"))
    return rank_by(h, ["host"])


# ------------------------------------------------------------ result views
def q_row_category(spark, sf):
    r = annotate(rank(_measured(spark, sf), sort=False))
    return r.select("id", "rank", "category", "color", "is_high")


def q_high_rank(spark, sf):
    r = annotate(rank(_measured(spark, sf), sort=False))
    return r.groupBy("is_high").agg(F.count(F.lit(1)).alias("n"))


def q_user_sort_page(spark, sf):
    r = rank(_measured(spark, sf), sort=False)
    s = user_sort(r, "content_length", "asc", rank_order(SCAN, True))
    return row_slice(s, 100, 150).select("id", "content_length", "rank")


def q_targets_selected(spark, sf):
    main, _ = _label_lists(spark, sf)
    r = rank(_measured(spark, sf), sort=False)
    return targets(r, main).select("id", "rank")


# ------------------------------------------------------------ sinks
def q_export_csv_projection(spark, sf):
    return csv_projection(rank(_measured(spark, sf)))


def q_curl_lines(spark, sf):
    r = rank(_measured(spark, sf), sort=False)
    return curl_lines(r, requests_with_raw(_history(spark, sf)))


def q_url_list(spark, sf):
    return in_rank_order(rank(_measured(spark, sf), sort=False)).select("id", "url")


def q_wordlist(spark, sf):
    """The words need no rank: the records with a response are those that are ranked."""
    return wordlist(response_features(_measured(spark, sf), SCAN))


def q_run_summary(spark, sf):
    s = run_summary(rank(_measured(spark, sf), sort=False), 1.5)
    return s.select("total_requests", "high_requests", "max_rank", "duration_ms")


def q_stored_run(spark, sf):
    """A run saved under a key, found again as the last one, and reused for its key."""
    path = f"{stored_dir(spark)}/runs-{uuid.uuid4().hex}"
    key = "scan " * 80  # longer than a folder name may be
    r = load_or_compute(spark, path, key, lambda: rank(_measured(spark, sf), sort=False))
    again = load_or_compute(spark, path, key, lambda: r.limit(0))
    index = run_index(spark, path).where(F.length("run_key") == len(key)).select("total_requests", "high_requests", "max_rank")
    both = last_run(spark, path).join(again.select("id"), "id", "left_semi")
    return both.select("id", "rank", "status_code", *[index.select(c).scalar().alias(c) for c in index.columns])


def q_scan_preset(spark, sf):
    rows = scan_history(with_filter_fields(_measured(spark, sf)), scan_all=True, filter="preset:large errors",
                        presets={"large errors": "status >= 400 AND length > 1000 AND time IS NOT NULL"})
    return rows.select("id", "status", "length")


def q_header_search(spark, sf):
    """Requests joined to their responses (J7), filtered on a header (C20) of a map with mixed-case names."""
    h = history_from_parts(*request_parts(spark, sf))
    return scan_history(h, scan_all=True, filter=header_contains("headers", "Content-Type: text/html")).select("id", "method", "status_code")


def q_rank_requests(spark, sf):
    """The rank of separate request and response tables with header maps (C3), all records of them."""
    return rank(history_from_parts(*request_parts(spark, sf)))


def q_rank_prefix(spark, sf):
    """C5: only the first 1,000 UTF-16 units of a body are fingerprinted; its length is that of the whole."""
    return rank(history_from_tables(spark, sf, bodies=False, max_body_units=1000))


def q_profile_grown(spark, sf):
    """The profile of a history that grew: the state of the older half of its time span, stored and read back,
    merged with the state of the newer records."""
    feats = _feats(spark, sf)
    half = feats.agg(F.timestamp_micros(((F.min(F.unix_micros(F.col("created_at").cast("timestamp"))) + F.max(F.unix_micros(F.col("created_at").cast("timestamp")))) / 2).cast("bigint")).alias("t")).first()["t"]
    older = F.coalesce(F.col("created_at").cast("timestamp") <= F.lit(half), F.lit(True))
    path = f"{stored_dir(spark)}/state-{uuid.uuid4().hex}"
    save_state(profile_state(feats.where(older), SCAN), path)
    return state_profile(merge_states(profile_state(feats.where(~older), SCAN), load_state(spark, path)))


def q_body_search(spark, sf):
    """Documents that hold a phrase, found through the index of tokens to files."""
    docs = read_table(spark, sf, "documents")
    path = f"{stored_dir(spark)}/index-{uuid.uuid4().hex}"
    build_index(docs, path, "text")
    return search(docs, path, "the tion", "text").select("doc_id", "lang")


def q_id_set_digest(spark, sf):
    """The key of a changed selection from the digest of the old one and those of what came and went."""
    main, extra = _label_lists(spark, sf)
    return digest_key(combine_digests(id_digest(main), added=id_digest(extra), removed=id_digest(main.join(extra, "id", "left_semi"))))


def q_user_sort_text(spark, sf):
    """O5 on a text column with locale rules, missing values last."""
    r = rank(_measured(spark, sf), sort=False)
    s = user_sort(r, "location", "asc", rank_order(SCAN, True))
    return row_slice(s, 0, 200).select("id", "location", "rank")


def q_id_set_key(spark, sf):
    main, extra = _label_lists(spark, sf)
    return id_set_key(main.unionByName(extra))


QUERIES: dict[str, Builder] = {
    "scan_recent": q_scan_recent,
    "scan_filtered": q_scan_filtered,
    "scan_limit": q_scan_limit,
    "scan_body_filter": q_scan_body_filter,
    "keyset_page": q_keyset_page,
    "selection_union": q_selection_union,
    "scope_filter": q_scope_filter,
    "url_parts": q_url_parts,
    "drop_no_response": q_drop_no_response,
    "mime_normalise": q_mime_normalise,
    "tokens": q_tokens,
    "fnv64": q_fnv64,
    "simhash_udf": q_simhash_udf,
    "simhash_native": q_simhash_native,
    "status_freq": q_status_freq,
    "type_freq": q_type_freq,
    "length_stats": q_length_stats,
    "centroid_mode": q_centroid_mode,
    "centroid_majority": q_centroid_majority,
    "profile": q_profile,
    "hamming_to_centroid": q_hamming_to_centroid,
    "length_outlier": q_length_outlier,
    "rarity": q_rarity,
    "rank_scan": q_rank_scan,
    "rank_topk": q_rank_topk,
    "rank_majority": q_rank_majority,
    "rank_native": q_rank_native,
    "rank_pages": q_rank_pages,
    "rank_ids": q_rank_ids,
    "rank_scan_limit": q_rank_scan_limit,
    "rank_by_host": q_rank_by_host,
    "row_category": q_row_category,
    "high_rank": q_high_rank,
    "user_sort_page": q_user_sort_page,
    "targets_selected": q_targets_selected,
    "export_csv_projection": q_export_csv_projection,
    "curl_lines": q_curl_lines,
    "url_list": q_url_list,
    "wordlist": q_wordlist,
    "run_summary": q_run_summary,
    "id_set_key": q_id_set_key,
    "stored_run": q_stored_run,
    "scan_preset": q_scan_preset,
    "header_search": q_header_search,
    "rank_requests": q_rank_requests,
    "rank_prefix": q_rank_prefix,
    "profile_grown": q_profile_grown,
    "body_search": q_body_search,
    "id_set_digest": q_id_set_digest,
    "user_sort_text": q_user_sort_text,
}
