"""respscore: response anomaly ranking on Spark.

Public API (DataFrame in, DataFrame out):

    rank, rank_ids, scan_and_rank, profile      plans.api
    rank_by                                     operators.grouped
    annotate, user_sort, row_slice, targets     operators.annotate
    scan_history, fetch_by_ids, selection_ids   sources.history
    export_csv, export_urls, export_curl,
    export_wordlist                             sinks.export
    save_run, load_run, last_run, clear_runs,
    run_summary                                 sinks.runs
    fit_baseline, score                         streaming.baseline
"""

from .operators.annotate import annotate, row_slice, targets, user_sort
from .operators.grouped import rank_by
from .plans.api import profile, rank, rank_ids, scan_and_rank
from .sinks.export import export_csv, export_curl, export_urls, export_wordlist
from .sinks.runs import clear_runs, last_run, load_run, run_summary, save_run
from .sources.history import fetch_by_ids, history_from_parts, scan_history, selection_ids
from .streaming.baseline import fit_baseline, score

__all__ = [
    "annotate", "clear_runs", "export_csv", "export_curl", "export_urls", "export_wordlist",
    "fetch_by_ids", "fit_baseline", "history_from_parts", "last_run", "load_run", "profile", "rank", "rank_by", "rank_ids",
    "row_slice", "run_summary", "save_run", "scan_and_rank", "scan_history", "score",
    "selection_ids", "targets", "user_sort",
]
