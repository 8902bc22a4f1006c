"""Command line: rank a history and export the result.

    python -m respscore scan --history PATH [--limit N | --all] [--filter SQL]
    python -m respscore ids --history PATH --ids PATH [--id-col id]
    common: --tables SF_DIR (derive history from the driver tables instead of PATH)
            --centroid mode|majority  --top K  --by COL[,COL]
            --out PATH  --format parquet|csv|urls|curl|wordlist  --run-key KEY

Runs on whatever session ``spark-submit`` provides (or a local one).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.annotate import annotate
from .plans.api import rank_ids, scan_and_rank
from .session import released
from .sinks.export import export_csv, export_curl, export_urls, export_wordlist
from .sinks.runs import history_version, id_set_key, load_or_compute, save_run, scan_key
from .sources.tables import history_from_tables


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="respscore", description="Rank HTTP responses by anomaly.")
    p.add_argument("command", choices=["scan", "ids"])
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--history", help="parquet history with the canonical schema")
    src.add_argument("--tables", help="driver table folder; history is derived from it")
    p.add_argument("--limit", type=int, default=500)
    p.add_argument("--all", action="store_true", help="scan every matching record")
    p.add_argument("--filter", default=None, help="Spark SQL predicate on history columns")
    p.add_argument("--ids", help="parquet id list: an id column plus position column(s) giving list order")
    p.add_argument("--id-col", default="id")
    p.add_argument("--centroid", choices=["mode", "majority"], default="mode")
    p.add_argument("--top", type=int, default=None)
    p.add_argument("--by", default=None, help="comma-separated group columns")
    p.add_argument("--out", required=True)
    p.add_argument("--format", choices=["parquet", "csv", "urls", "curl", "wordlist"], default="parquet")
    p.add_argument("--run-key", default=None,
                   help="store as a run; 'auto' derives the key from the arguments and data version, "
                        "or from the id set, and keeps a run that is already stored")
    return p


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("respscore").getOrCreate()
    history = (spark.read.parquet(a.history) if a.history else history_from_tables(spark, a.tables))
    if a.format == "curl" and "raw" not in history.columns:
        raise SystemExit("--format curl needs the requests' own text: a raw column in --history")
    by = [c.strip() for c in a.by.split(",")] if a.by else None
    if a.command == "scan":
        def compute():
            return scan_and_rank(history, limit=a.limit, scan_all=a.all, filter=a.filter,
                                 centroid=a.centroid, by=by, top=a.top)
    else:
        if not a.ids:
            raise SystemExit("--ids is required for the ids command")
        ids = spark.read.parquet(a.ids)
        ids = ids.select(F.col(a.id_col).alias("id"), *[c for c in ids.columns if c != a.id_col])

        def compute():
            return rank_ids(history, ids, centroid=a.centroid, by=by, top=a.top)
    with released():
        if a.run_key == "auto":
            key = (scan_key(a.limit, a.all, a.filter, history_version(history)) if a.command == "scan"
                   else id_set_key(ids).first()["run_key"])
            options = ":".join(f"{k}={v}" for k, v in (("centroid", a.centroid), ("by", a.by), ("top", a.top)) if v)
            load_or_compute(spark, a.out, f"{key}:{options}", compute)
        elif a.run_key:
            save_run(compute(), a.out, a.run_key)
        elif a.format == "parquet":
            annotate(compute()).write.mode("overwrite").parquet(a.out)
        elif a.format == "csv":
            export_csv(compute(), a.out)
        elif a.format == "urls":
            export_urls(compute(), a.out)
        elif a.format == "wordlist":
            export_wordlist(compute(), a.out)
        else:
            export_curl(compute(), history.select("id", "raw"), a.out)


if __name__ == "__main__":
    main()
