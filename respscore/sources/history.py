"""History entry points: scan with filter/limit, fetch by id list, selection,
keyset paging and scope restriction."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import SCAN_DEFAULT_LIMIT, SCAN_MIN_LIMIT
from ..operators.features import measure_bodies
from ..operators.joins import key_join
from ..operators.select import FEW, first_rows
from ..session import materialize

SCAN_ORDER = ("created_at", "id")


def history_from_parts(requests: DataFrame, responses: DataFrame,
                       response_key: str = "response_id", key: str = "id") -> DataFrame:
    """Canonical history from separate request and response tables (J7).

    ``requests`` holds id, created_at, method, url (and optionally raw);
    ``responses`` holds ``key`` plus status_code, body and either
    content_type_header/location or a ``headers`` map.  A request whose
    ``response_key`` finds no response keeps has_response = false.  Both
    sides grow with the data, so this is a plain key join (sort-merge at
    scale); tables bucketed by the key on both sides join without a
    shuffle."""
    resp = responses.select(*[F.col(c).alias(f"_r_{c}") for c in responses.columns])
    j = requests.join(resp, requests[response_key] == resp[f"_r_{key}"], "left")
    out = [F.col(c) for c in requests.columns if c != response_key]
    out.append(F.col(f"_r_{key}").isNotNull().alias("has_response"))
    out += [F.col(f"_r_{c}").alias(c) for c in responses.columns if c != key and c not in requests.columns]
    return j.select(*out)


def bucket_parts(requests: DataFrame, responses: DataFrame, folder: str, name: str, buckets: int,
                 response_key: str = "response_id", key: str = "id") -> None:
    """Store request and response tables bucketed and sorted by the key that joins them (``name``_requests,
    ``name``_responses, files below ``folder``), once, so that no later join of theirs shuffles.

    A request without a response would share one bucket with all others like it; these are kept in a
    table of their own (``name``_unanswered) that is joined with nothing."""
    def save(df: DataFrame, what: str, by: str | None) -> None:
        out = df.write.mode("overwrite").format("parquet").option("path", f"{folder.rstrip('/')}/{what}")
        (out.bucketBy(buckets, by).sortBy(by) if by else out).saveAsTable(f"{name}_{what}")

    save(requests.where(F.col(response_key).isNotNull()).repartition(buckets, response_key), "requests", response_key)
    save(requests.where(F.col(response_key).isNull()), "unanswered", None)
    save(responses.repartition(buckets, key), "responses", key)


def bucketed_history(spark: SparkSession, name: str, response_key: str = "response_id", key: str = "id") -> DataFrame:
    """The history of tables stored by ``bucket_parts``: ``history_from_parts`` without an exchange."""
    joined = history_from_parts(spark.table(f"{name}_requests"), spark.table(f"{name}_responses"), response_key, key)
    alone = spark.table(f"{name}_unanswered").drop(response_key).withColumn("has_response", F.lit(False))
    return joined.unionByName(alone, allowMissingColumns=True)


def drop_bucketed(spark: SparkSession, name: str) -> None:
    """Forget tables stored by ``bucket_parts`` (their files stay below the folder they were given)."""
    for what in ("requests", "unanswered", "responses"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{what}")


def resolve_filter(filter: Column | str | None,
                   presets: Mapping[str, Column | str] | None = None) -> Column | None:
    """A user filter: a Column, a SQL predicate string, ``preset:<name>`` for a
    named predicate from ``presets``, or blank/None for no filter."""
    if filter is None:
        return None
    if isinstance(filter, Column):
        return filter
    text = filter.strip()
    if not text:
        return None
    if text.startswith("preset:"):
        name = text[len("preset:"):].strip()
        if not presets or name not in presets:
            raise KeyError(f"unknown filter preset: {name!r}")
        return resolve_filter(presets[name])
    return F.expr(text)


def validate_filter(history: DataFrame, filter: Column | str | None,
                    presets: Mapping[str, Column | str] | None = None) -> dict:
    """``{"valid": bool, "error": str | None}`` for a user filter, judged by
    Spark's own parser and analyzer against the history's columns (blank is
    valid).  Nothing runs: only the plan is analysed."""
    try:
        pred = resolve_filter(filter, presets)
        if pred is not None:
            history.where(pred).schema  # forces analysis, not execution
        return {"valid": True, "error": None}
    except (ParseException, AnalysisException, KeyError) as e:  # KeyError: unknown preset
        return {"valid": False, "error": str(e).splitlines()[0] if str(e) else type(e).__name__}


def apply_filter(history: DataFrame, filter: Column | str | None = None,
                 presets: Mapping[str, Column | str] | None = None) -> DataFrame:
    pred = resolve_filter(filter, presets)
    return history if pred is None else history.where(pred)


def with_filter_fields(history: DataFrame) -> DataFrame:
    """Add the filter fields a user writes predicates on: scheme, host, port,
    path, query, ext (from the URL), length (body bytes), status, time and,
    where the history says where a record comes from, source.  method, headers
    and body are already columns; e.g.
    ``scan_history(with_filter_fields(h), filter="length > 1000 AND ext = 'js' AND status >= 400")``."""
    from ..functions.text import content_length
    from ..functions.url import with_url_parts

    h = with_url_parts(history, "url")
    more = {"status": F.col("status_code"), "time": F.col("created_at")}
    if "body" in h.columns:
        more["length"] = content_length("body")
    elif "content_length" in h.columns:
        more["length"] = F.col("content_length")
    return h.withColumns({k: v for k, v in more.items() if k not in h.columns})


def check_limit(limit: int) -> int:
    if not isinstance(limit, int) or limit < SCAN_MIN_LIMIT:
        raise ValueError(f"limit must be {SCAN_MIN_LIMIT} or more")
    return limit


def scan_history(history: DataFrame, limit: int = SCAN_DEFAULT_LIMIT, scan_all: bool = False,
                 filter: Column | str | None = None,
                 presets: Mapping[str, Column | str] | None = None) -> DataFrame:
    """Records matching ``filter``: the ``limit`` newest (created_at desc,
    id desc), or all of them with ``scan_all`` (then ``limit`` has no meaning)."""
    rows = apply_filter(history, filter, presets)
    return rows if scan_all else newest(rows, limit)


def _at(value, kind: T.DataType) -> Column:
    """A collected key as a literal of its column's type, exact to the microsecond."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast(kind)


def newest(rows: DataFrame, k: int) -> DataFrame:
    """The k newest rows (created_at desc, id desc; nulls last), unordered.

    One small job finds the k-th and the next key on the two key columns
    alone; the result is then a filter from the k-th key on, which reaches
    the scan, so bodies are read once, where they lie.  Only where those two
    keys are equal (ids are meant to be unique) are rows of that key counted
    out by a limit, so never more than k come back.  For more rows than one
    task should merge, the k-th key is found by counting ranges of keys
    (``operators.select``)."""
    check_limit(k)
    if k > FEW:
        return first_rows(rows, SCAN_ORDER, True, k, FEW)
    kinds = [rows.schema[c].dataType for c in SCAN_ORDER]
    plain = [F.unix_micros(c) if isinstance(t, T.TimestampType) else F.col(c).cast("string") if isinstance(t, T.TimestampNTZType) else F.col(c)
             for c, t in zip(SCAN_ORDER, kinds, strict=True)]
    order = [F.col(c).desc() for c in SCAN_ORDER]
    keys = rows.select(*SCAN_ORDER).orderBy(*order).limit(k + 1).offset(k - 1).select(*[p.alias(c) for p, c in zip(plain, SCAN_ORDER, strict=True)]).collect()
    if not keys:  # fewer than k
        return rows
    last = [_at(v, t) for v, t in zip(keys[0], kinds, strict=True)]
    key = F.struct(*SCAN_ORDER)
    cut = F.struct(*[x.alias(c) for x, c in zip(last, SCAN_ORDER, strict=True)])
    from_cut = rows if keys[0][0] is None else rows.where(F.col(SCAN_ORDER[0]) >= last[0])  # this part is pushed to the scan
    if len(keys) < 2 or tuple(keys[0]) != tuple(keys[1]):
        return from_cut.where(key >= cut)
    above = from_cut.where(key > cut)
    return above.unionByName(from_cut.where(key.eqNullSafe(cut)).limit(k - above.count()))


def keyset_page(history: DataFrame, page_size: int = 1000,
                after: Column | None = None, filter: Column | str | None = None) -> DataFrame:
    """One page of the recency order strictly after the cursor ``after``
    (a struct(created_at, id) value; None = first page), in page order."""
    rows = apply_filter(history, filter)
    if after is not None:
        rows = rows.where(F.struct("created_at", "id") < after)
    return newest(rows, int(page_size)).orderBy(F.col("created_at").desc(), F.col("id").desc())


def page_cursor(page: DataFrame) -> Column:
    """Cursor after ``page``: its last (oldest) key, as a scalar subquery."""
    return page.select(F.min(F.struct("created_at", "id"))).scalar()


def fetch_by_ids(history: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    """Records for an id list (``ids`` has ``id`` plus position columns).

    Ids without a record drop out; an id listed twice is fetched twice (the
    list's position columns keep the two apart)."""
    return key_join(history, ids, on)


def attach_bodies(rows: DataFrame, bodies: DataFrame, on: str = "id", key: str = "id", body: str = "body",
                  max_body_units: int | None = None, fingerprint: str = "udf", materialize_how: str = "auto") -> DataFrame:
    """``rows`` with ``content_length`` and ``fingerprint`` of their bodies, fetched late: the rows are
    chosen first, without bodies, and only theirs are read and measured.

    ``bodies`` holds ``key`` and ``body``.  The least and greatest wanted key are pushed to its scan (row
    groups and files outside are skipped), a semi-join leaves the wanted ones (Spark broadcasts the
    keys under its threshold; beyond it, ``bodies`` bucketed by ``key`` is joined in place), and what is
    joined to the rows is some 30 bytes each.  A row without a body has length 0 and fingerprint 0."""
    rows = materialize(rows, materialize_how)
    span = rows.agg(F.min(on).alias("lo"), F.max(on).alias("hi")).first()
    found = bodies.select(F.col(key).alias("_body_key"), F.col(body).alias("_body"))
    found = found.where(F.col("_body_key").between(F.lit(span["lo"]), F.lit(span["hi"]))) if span["lo"] is not None else found.where(F.lit(False))
    found = key_join(found, rows.select(F.col(on).alias("_body_key")).distinct(), "_body_key", "left_semi")
    measured = measure_bodies(found, "_body", max_body_units, fingerprint)
    both = rows.join(measured, rows[on] == measured["_body_key"], "left").drop("_body_key")
    return both.fillna(0, ["content_length", "fingerprint"])


def selection_ids(*frames: DataFrame, id_col: str = "id", pos_col: str = "pos") -> DataFrame:
    """Union of several ordered id lists with first-seen order.

    Frame k's rows come after frame k-1's; inside a frame ``pos_col``
    (BIGINT) orders them.  Null and empty ids are dropped.  Output: id,
    src (frame index of first sighting), pos (its position there).

    First-seen = min of one DECIMAL code (src * 2e19 + pos + 2^63), which
    stays in a hash aggregate, then the code is split back into its parts."""
    wide = F.expr("cast('20000000000000000000' as decimal(38,0))")
    shift = F.expr("cast('9223372036854775808' as decimal(38,0))")
    parts = [f.select(F.col(id_col).alias("id"),
                      (F.lit(k).cast("decimal(38,0)") * wide
                       + F.col(pos_col).cast("decimal(38,0)") + shift).alias("_code"))
             for k, f in enumerate(frames)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.where(F.col("id").isNotNull() & (F.col("id").cast("string") != ""))
    first = u.groupBy("id").agg(F.min("_code").alias("_code"))
    src = F.floor(F.col("_code") / wide)
    return first.select("id", src.cast("int").alias("src"),
                        (F.col("_code") - src * wide - shift).cast("bigint").alias("pos"))


def scope_filter(history: DataFrame, scope: DataFrame, host_col: str = "host") -> DataFrame:
    """Keep records whose URL host is in ``scope`` (a one-column host list); a record without a host is out."""
    from ..functions.url import url_host

    h = history.withColumn("_host", url_host("url"))
    s = scope.select(F.lower(F.col(host_col)).alias("_host")).where("_host IS NOT NULL").distinct()
    return key_join(h, s, "_host", "left_semi").drop("_host")
