"""User-level entry points (the public API).

* ``rank``          - rank a history DataFrame (R1)
* ``rank_ids``      - rank an id list against a history (R2)
* ``scan_and_rank`` - scan history with filter/limit, then rank (R3)
* ``profile``       - one-row dataset profile (R4)
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame

from ..functions.constants import SCAN_DEFAULT_LIMIT
from ..operators.features import measure_bodies, response_features
from ..operators.joins import key_join
from ..operators.profile import profile_frame
from ..operators.score import rank_responses
from ..session import materialize
from ..sources.history import SCAN_ORDER, attach_bodies, fetch_by_ids, scan_history


def rank(history: DataFrame, order: Sequence[str] = SCAN_ORDER, descending: bool = True,
         centroid: str = "mode", by: Sequence[str] | None = None, **kw) -> DataFrame:
    """Rank every record with a response; see ``rank_responses``.  With
    ``by`` group columns, each group is ranked against its own statistics
    (``operators.grouped.rank_by``)."""
    if by:
        from ..operators.grouped import rank_by
        return rank_by(history, by, order=order, descending=descending, centroid=centroid, **kw)
    return rank_responses(history, order=order, descending=descending, centroid=centroid, **kw)


def rank_ids(history: DataFrame, ids: DataFrame, order: Sequence[str] | None = None,
             centroid: str = "mode", by: Sequence[str] | None = None, few: bool = False,
             bodies: DataFrame | None = None, **kw) -> DataFrame:
    """Rank the records of an id list.

    ``ids`` holds ``id`` and position column(s) (default: every other
    column) giving the list order, ascending.  Ids without a record or
    response drop out; an id listed twice is ranked twice.  Bodies are
    measured where they lie and the list joins the narrow rows; for ``few``
    ids of a large history, records are first cut down to the listed ones
    (so that only those are measured).  ``bodies`` (id, body) keeps bodies out
    of ``history``: the listed records are found first, then their bodies."""
    order = list(order) if order is not None else [c for c in ids.columns if c != "id"]
    if not order:
        raise ValueError("ids needs a position column (e.g. from posexplode)")
    hist = history.drop(*[c for c in order if c in history.columns])
    ids = ids.select("id", *order)
    if bodies is not None:
        cut = {k: kw.pop(k) for k in ("max_body_units", "fingerprint") if k in kw}
        listed = fetch_by_ids(hist.where("has_response") if "has_response" in hist.columns else hist, ids)
        return rank(attach_bodies(listed, bodies, **cut), order, False, centroid, by, **kw)
    if few:
        hist = key_join(hist, ids.select("id").distinct(), "id", "left_semi")
    if "body" in hist.columns:
        cut = {"max_body_units": kw.pop("max_body_units", None), "fingerprint": kw.pop("fingerprint", "udf")}
        if "has_response" in hist.columns:
            hist = hist.where("has_response")
        hist = measure_bodies(hist, "body", **cut)
    return rank(fetch_by_ids(hist, ids), order, False, centroid, by, **kw)


def scan_and_rank(history: DataFrame, limit: int = SCAN_DEFAULT_LIMIT, scan_all: bool = False,
                  filter: Column | str | None = None,
                  presets: Mapping[str, Column | str] | None = None,
                  centroid: str = "mode", by: Sequence[str] | None = None,
                  bodies: DataFrame | None = None, **kw) -> DataFrame:
    """Scan history (newest first, optional filter and limit) and rank it.
    No matching record gives an empty result.  With ``bodies`` (id, body) the
    history holds none: records are chosen by their other fields, and only
    the chosen ones' bodies are read and fingerprinted."""
    rows = scan_history(history, limit=limit, scan_all=scan_all, filter=filter, presets=presets)
    if bodies is not None:
        cut = {k: kw.pop(k) for k in ("max_body_units", "fingerprint") if k in kw}
        rows = attach_bodies(rows.where("has_response") if "has_response" in rows.columns else rows, bodies, **cut)
    return rank(rows, SCAN_ORDER, True, centroid, by, **kw)


def profile(history: DataFrame, order: Sequence[str] = SCAN_ORDER, descending: bool = True,
            centroid: str = "mode", max_body_units: int | None = None,
            materialize_how: str = "auto") -> DataFrame:
    """One row: n, mean_length, sd_length (population, 0 -> 1), centroid."""
    feats = materialize(response_features(history, order, max_body_units), materialize_how)
    return profile_frame(feats, list(order), descending, centroid)


def ids_from_list(spark, ids: Sequence, pos_col: str = "pos") -> DataFrame:
    """An id-list DataFrame from a driver-side list (for small interactive
    selections; large selections should come from a table)."""
    id_type = "bigint" if ids and all(isinstance(i, int) for i in ids) else "string"
    return spark.createDataFrame([(i, k) for k, i in enumerate(ids)], f"id {id_type}, {pos_col} bigint")
