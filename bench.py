"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_QUERIES (comma list).
Each query is computed in full and thrown away (noop sink); building its DataFrame counts as well.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sessiograph.plans.catalog import catalog  # noqa: E402
from sessiograph.session import build_session  # noqa: E402

HEADLINE = [
    # text and session tables
    "project_text_schema", "session_text_stats", "session_audio_stats", "text_anomaly_score", "text_session_verdict", "tfidf_features",
    # joins
    "resolve_label_conflicts", "join_segments_features", "tolerance_join_pause", "interval_join_words", "priority_key_join",
    "chunk_frame_range_join", "nearest_point_join",
    # frames
    "smooth_moving_average", "delta_regression", "leaky_counter", "exponential_smoothing", "episodes_from_flags", "turn_detection",
    "video_risk_timeline", "phrase_match_fuzzy",
    # functionals, metrics, scores
    "fn_percentiles", "fn_peaks2", "acoustic_functional_set", "roc_auc", "grid_f1_threshold", "score_percentile_90", "top_segments",
    "ensemble_average", "analyze_session", "foreign_model_udf",
    # streams and sinks
    "stream_tumbling_functionals", "stream_frame_state", "upsert_by_session", "csv_sink",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    keys = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k] or HEADLINE
    spark = build_session("bench", cpus, int(cpus) if cpus.isdigit() else 8, {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the executors
    queries, times = catalog().queries, {}
    for key in keys:
        start = time.perf_counter()
        queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
