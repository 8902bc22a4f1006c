"""Readers for the driver tables and the history views derived from them.

``history_from_tables`` builds the canonical request/response history from
``events`` (requests), ``documents`` (response bodies, by equal key) and
``pages`` (URLs).  The same derivation exists as SQL for the DuckDB oracle
(``plans.oracle.HISTORY_CTE``), so both sides rank identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import measure_bodies

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def history_from_tables(spark: SparkSession, sf_dir: str, bodies: bool | None = True,
                        max_body_units: int | None = None, fingerprint: str = "udf") -> DataFrame:
    """Canonical history (id, created_at, method, url, has_response,
    status_code, content_type_header, location, body).

    URLs go round over all pages: event e has the page whose id is e modulo
    the number of pages (a null URL where there is none).  With ``bodies``
    false, documents are measured before the joins (``measure_bodies``):
    content_length and fingerprint stand in for body, and what is joined is
    some 30 bytes a row.  ``None`` leaves bodies out altogether (``document_bodies``
    has them, for ``attach_bodies``).  All joins are plain."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("body"))
    if bodies is None:
        d = d.drop("body")
    elif not bodies:
        d = measure_bodies(d, "body", max_body_units, fingerprint)
    pages = read_table(spark, sf_dir, "pages")
    p = pages.select(F.col("page_id").alias("_slot"), "url")
    n_pages = pages.agg(F.count(F.lit(1)).alias("n")).scalar()
    j = e.join(d, e.event_id == d.doc_id, "left").withColumn("_slot", F.try_mod(F.col("event_id"), n_pages))
    j = j.join(p, "_slot", "left")
    et = F.col("event_type")
    status = (F.when(et.isin("view", "click"), 200).when(et == "signup", 201)
              .when(et == "purchase", 302)
              .otherwise(F.when(F.col("user_id") % 2 == 0, 500).otherwise(404)))
    lang = F.col("lang")
    ctype = (F.when(lang == "en", "text/html; charset=UTF-8")
             .when(lang == "fr", "Application/JSON")
             .when(lang == "de", F.when(F.col("event_id") % 2 == 0, "image/svg+xml")
                   .otherwise("application/xhtml+xml; q=1")))
    return j.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.when(et.isin("signup", "purchase"), "POST").otherwise("GET").alias("method"),
        F.col("url"),
        F.col("doc_id").isNotNull().alias("has_response"),
        status.cast("int").alias("status_code"),
        ctype.alias("content_type_header"),
        F.when(et == "purchase", F.col("url")).alias("location"),
        *([] if bodies is None else [F.col("body")] if bodies else [F.col("content_length"), F.col("fingerprint")]),
    )


def document_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, body) of the derived history."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))


def pages_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as one 200 text/html response (id = page_id)."""
    return read_table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"),
        F.lit("GET").alias("method"),
        F.col("url"),
        F.lit(True).alias("has_response"),
        F.lit(200).alias("status_code"),
        F.lit("text/html").alias("content_type_header"),
        F.lit(None).cast("string").alias("location"),
        F.col("html").alias("body"),
    )


def request_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same records as separate requests and responses with a header map whose names are in mixed case.
    Bodies are measured before any join: responses hold content_length and fingerprint."""
    h = history_from_tables(spark, sf_dir, bodies=False)
    requests = h.select("id", "created_at", "method", "url", F.when(F.col("has_response"), F.col("id")).alias("response_id"))
    headers = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("Content-Type").alias("key"), F.array("content_type_header").alias("value")),
        F.struct(F.lit("LOCATION").alias("key"), F.array("location").alias("value"))), lambda x: x["value"][0].isNotNull()))
    return requests, h.where("has_response").select("id", "status_code", headers.alias("headers"), "content_length", "fingerprint")


def requests_with_raw(history: DataFrame) -> DataFrame:
    """(id, raw): a made-up raw HTTP/1.1 request text per record of the test tables, which have none.

    Request line, Host and X-Id headers, an empty line, then a body."""
    from ..functions.url import url_host

    crlf = "\r\n"
    raw = F.concat(F.col("method"), F.lit(" / HTTP/1.1" + crlf + "Host: "), F.coalesce(url_host("url"), F.lit("")),
                   F.lit(crlf + "X-Id: "), F.col("id").cast("string"),
                   F.lit(crlf + crlf + "body"))
    return history.select("id", raw.alias("raw"))
