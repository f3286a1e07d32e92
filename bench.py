"""Times headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores. Results shared between queries are dropped before
each timed query, so every time covers the whole work from the driver tables on; "own" is the time of the same query
over shared results that are already there. One untimed query warms the JVM up; BENCH_REPEATS runs each query more
than once and keeps the best time.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from contract import load_queries, model_queries, tables  # noqa: E402
from labelloom.scale.staging import clear_staged, ensure_shared_dir  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
REPEATS = int(os.environ.get("BENCH_REPEATS", "1"))

HEADLINE = [
    "prepare",
    "prepare_funnel",
    "train_val_test_split",
    "split_leakage",
    "text_key",
    "tfidf_clean",
    "simple_tokenize",
    "word_ngrams",
    "char_wb_ngrams",
    "term_stats",
    "select_vocab",
    "tfidf_transform",
    "build_vocab",
    "encode",
    "oov_stats",
    "classification_report",
    "group_metrics",
    "fn_samples",
    "overall_summary",
    "duplicate_share",
    "selection_bias",
    "length_describe",
    "token_length_stats",
    "top_tokens",
    "fit_tfidf_lr",
    "predict_batch",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("labelloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_shared_dir(spark)
    return spark


def timed(spark: SparkSession, query) -> tuple[float, float]:
    """Seconds of the whole work, and of the operator alone: a second run over the shared results of the first."""
    tables.forget()
    model_queries.forget()
    start = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    whole = time.perf_counter() - start
    own = whole
    if tables.shared_results():
        start = time.perf_counter()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        own = time.perf_counter() - start
    clear_staged(spark)
    return whole, own


def main() -> None:
    queries, _ = load_queries()
    with contextlib.redirect_stdout(sys.stderr):
        spark = session()
        timed(spark, queries["prepare"])
        seconds, own = {}, {}
        for name in HEADLINE:
            runs = [timed(spark, queries[name]) for _ in range(REPEATS)]
            seconds[name], own[name] = (round(min(r[i] for r in runs), 3) for i in range(2))
            print(name, seconds[name], own[name], file=sys.stderr)
        spark.stop()
    scale = Path(SF_DIR).name.removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "own": own, "sf": scale}))


if __name__ == "__main__":
    main()
