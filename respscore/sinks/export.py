"""Exports of rank results: CSV, URL list, cURL lines, URL word list.

Each export is a projection (returned for inspection/testing) plus a
writer.  Writers emit a directory of part files in rank order (sorted again
where a selection or a request is joined); nothing is gathered on the driver.  Unlike a bare comma join, Spark's CSV
writer quotes a field that holds a comma.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CSV_HEADER
from ..functions.text import _col
from ..operators.annotate import targets
from ..operators.score import rank_order

CRLF = "\r\n"


def in_rank_order(results: DataFrame, order: Sequence[str] | None = None, descending: bool | None = None) -> DataFrame:
    """Results in rank order, ties in input order: a scan's (newest first) if the results hold
    created_at, else their position columns ascending; ``order`` and ``descending`` say otherwise."""
    scan = "created_at" in results.columns
    keys = list(order) if order is not None else ["created_at", "id"] if scan else [c for c in results.columns if c in ("src", "pos")]
    return results.orderBy(*rank_order(keys, scan if descending is None else descending))


def csv_projection(results: DataFrame) -> DataFrame:
    """Six columns: Rank, Method, Status, Length, Type, URL."""
    src = ("rank", "method", "status_code", "content_length", "content_type", "url")
    return results.select(*[F.col(s).alias(d) for s, d in zip(src, CSV_HEADER)])


def export_csv(results: DataFrame, path: str, selection: DataFrame | None = None,
               mode: str = "overwrite") -> None:
    csv_projection(in_rank_order(targets(results, selection))).write.mode(mode).option("header", True).csv(path)


def export_urls(results: DataFrame, path: str, selection: DataFrame | None = None,
                mode: str = "overwrite") -> None:
    """One URL per line, in result order, duplicates kept."""
    in_rank_order(targets(results, selection)).select("url").write.mode(mode).text(path)


def curl_command(raw: Column | str, url: Column | str) -> Column:
    """``curl -X <method> -H "<header>" ... "<url>"`` from a raw request.

    Method = first word of the request line; headers = the lines after it
    up to the first empty line (all remaining lines when there is none).
    No body, no escaping.  Null when there is no raw request."""
    lines = F.split(_col(raw), CRLF)
    method = F.split(F.element_at(lines, 1), " ").getItem(0)
    blank = F.array_position(lines, "")
    n_headers = F.when(blank > 0, blank - 2).otherwise(F.size(lines) - 1)
    headers = F.slice(lines, 2, F.greatest(n_headers, F.lit(0)))
    flags = F.transform(headers, lambda h: F.concat(F.lit('-H "'), h, F.lit('"')))
    # template "curl -X {method} {headers} \"{url}\"" (two spaces when no headers)
    parts = F.concat(F.lit("curl -X "), method, F.lit(" "), F.array_join(flags, " "),
                     F.lit(' "'), _col(url), F.lit('"'))
    return F.when(_col(raw).isNull(), F.lit(None)).otherwise(parts)


def curl_lines(results: DataFrame, requests: DataFrame, raw_col: str = "raw") -> DataFrame:
    """(id, curl) for each result that has a raw request (J7: result ->
    request by id), in rank order.  Rows without raw text are skipped."""
    req = requests.select("id", F.col(raw_col).alias("_raw"))
    j = in_rank_order(results.join(req, "id", "inner").where(F.col("_raw").isNotNull() & (F.col("_raw") != "")))
    return j.select("id", curl_command("_raw", "url").alias("curl"))


def export_curl(results: DataFrame, requests: DataFrame, path: str,
                selection: DataFrame | None = None, mode: str = "overwrite") -> None:
    """cURL commands separated by a blank line."""
    (curl_lines(targets(results, selection), requests).select("curl")
     .write.mode(mode).option("lineSep", "\n\n").text(path))


def wordlist(results: DataFrame) -> DataFrame:
    """Distinct URLs: the word list for a URL fuzzer (``-w urls.txt:URL -u URL``)."""
    return results.select("url").where(F.col("url") != "").distinct()


def export_wordlist(results: DataFrame, path: str, selection: DataFrame | None = None,
                    mode: str = "overwrite") -> None:
    wordlist(targets(results, selection)).write.mode(mode).text(path)
