"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query is warmed up once and then timed, best of $BENCH_RUNS, into a noop sink so that
no column is pruned away. Fitted models and stored inputs are built before the clock starts,
except in the two queries that time a fit.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("inkprint-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def headline(spark: SparkSession):
    """name -> (prepare, run); run returns a DataFrame to be drained."""
    from inkprint.functions.text import STYLE_FEATURES, with_style_features
    from inkprint.operators import detectors, features
    from inkprint.operators.corpus import in_split
    from inkprint.plans import queries as q
    from inkprint.plans import views
    from inkprint.sources.files import spread

    def documents():
        docs = views.table(spark, SF_DIR, "documents")
        return spread(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("code")), "id")

    def style(tokens):
        return with_style_features(documents(), tokens=tokens).select("id", *STYLE_FEATURES)

    def fit():
        train = in_split(q._code_features(spark, SF_DIR), "train")
        trees = detectors.boosted_trees(20, 6)
        return detectors.top_importances(detectors.fit_pipeline(trees, features.FEATURES, train), spark)

    runs = {
        "style_features_jvm": lambda: style("space"),
        "style_features_tokenizer": lambda: style("python"),
        "boosted_fit_20_rounds": fit,
    }
    for name in (
        "flagship",
        "prepare_dataset",
        "dedup_keep_first",
        "stratified_split",
        "roc_auc",
        "median_threshold",
        "extract_functions",
        "ast_counts",
        "ast_node_fractions",
        "feature_matrix",
        "attack_registry",
        "ngram_log_likelihood",
        "curvature_score",
        "zero_shot_eval",
        "robustness_eval",
        "cross_model_matrix",
        "lexical_classifier",
        "tree_shap",
        "score_snippets",
    ):
        run = q.flagship if name == "flagship" else q.QUERIES[name]
        runs[name] = lambda run=run: run(spark, SF_DIR)
    only = sys.argv[1:]
    return {n: r for n, r in runs.items() if not only or n in only}


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    from inkprint.plans import queries as q

    runs = headline(spark)
    q._code_model(spark, SF_DIR)
    seconds = {}
    for name, run in runs.items():
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            drain(run())
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": CPUS,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
