"""Shapes of the plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from inkprint.functions.pysyntax import ast_node_table
from inkprint.functions.text import STYLE_FEATURES, with_style_features
from inkprint.operators import corpus as C
from inkprint.operators import features as FE
from inkprint.operators import metrics as M
from inkprint.operators import robustness as RB
from inkprint.operators import score as S
from inkprint.operators.ranking import stratified_split
from inkprint.plans import queries as Q
from inkprint.plans import views as V


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored_code(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "code")
    V.code_corpus(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def test_style_features_stay_in_the_jvm(stored_code):
    plan = plan_of(with_style_features(stored_code, tokens="space").select("id", *STYLE_FEATURES))
    assert "Python" not in plan and "Exchange" not in plan
    scan = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert scan == "id:string,code:string"


def test_feature_matrix_is_one_narrow_python_pass(stored_code):
    plan = plan_of(FE.feature_matrix(stored_code))
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_scoring_is_narrow(spark, sf, stored_code):
    plan = plan_of(S.score_snippets(stored_code, Q._code_model(spark, sf)))
    assert not re.search(r"Exchange|HashJoin|MergeJoin|NestedLoopJoin", plan)


def test_split_labels_in_place(stored_code):
    plan = plan_of(stratified_split(stored_code))
    assert "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_dedup_combines_before_its_only_shuffle(stored_code):
    df = stored_code.withColumn("src_ord", F.lit(0))
    plan = plan_of(C.dedup_keep_first(df))
    assert plan.count("Exchange") == 1 and "partial_min_by" in plan


def test_node_table_collapses_before_its_shuffle(stored_code):
    plan = plan_of(ast_node_table(stored_code).groupBy("id").count())
    assert plan.index("Exchange") < plan.rindex("partial_count") < plan.index("MapInArrow")


def test_no_window_spans_a_whole_group(spark, sf):
    plan = plan_of(M.roc_auc(V.scored(spark, sf), ["model"]))
    ranked = [w for w in re.findall(r"Window \[.*", plan) if "score" in w]
    assert ranked and all("_bucket" in w for w in ranked)


def test_attacks_unfold_without_a_join(stored_code):
    plan = plan_of(RB.attack_rows(stored_code))
    assert "Join" not in plan and plan.count("ArrowEvalPython") <= 2


def test_every_query_plan_has_no_cartesian_product(spark, sf):
    for name in ("prompt_grid", "attack_grid", "perturbation_grid", "union_train_eval"):
        assert "CartesianProduct" not in plan_of(Q.QUERIES[name](spark, sf))


def test_requests_are_not_shuffled_by_model(spark, sf):
    plan = plan_of(Q.QUERIES["generate_requests"](spark, sf))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def hot_groups(spark):
    """Nine of ten rows in one group."""
    return spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(F.lit(99)).alias("g"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("score"),
        (F.col("id") % 2).cast("int").alias("label"),
    )


def without_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return old


def test_medians_and_ranks_shuffle_no_rows_by_group_alone(spark):
    old = without_broadcast(spark)
    try:
        medians = plan_of(M.median_predictions(hot_groups(spark), "score", ["g"]))
        assert not re.search(r"hashpartitioning\(g#\d+L?, \d+\)", medians)
        auc = plan_of(M.roc_auc(hot_groups(spark), ["g"], buckets=16))
        by_group = re.findall(r"Exchange hashpartitioning\(g#\d+L?, \d+\)[^\n]*\n[^\n]*", auc)
        # what is left by group has a row per bucket
        assert all("partial_sum" in step or "HashAggregate" in step or "Project" in step for step in by_group)
        assert "SortMergeJoin" not in auc
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("bound", [10_000, 2])
def test_groups_beyond_the_bound_are_salted(spark, monkeypatch, bound):
    import inkprint.storage as storage

    monkeypatch.setattr(storage, "MAX_BROADCAST_GROUPS", bound)
    rows = hot_groups(spark).collect()
    judged = M.median_predictions(hot_groups(spark), "score", ["g"]).select("g", "threshold").distinct()
    got = {r.g: r.threshold for r in judged.collect()}
    expected = {}
    for r in rows:
        expected.setdefault(r.g, []).append(r.score)
    import statistics

    assert got == pytest.approx({g: statistics.median(v) for g, v in expected.items()})
    for buckets in (2, 16):
        for r in M.roc_auc(hot_groups(spark), ["g"], buckets=buckets).collect():
            own = [x for x in rows if x.g == r.g]
            pos, neg = [x.score for x in own if x.label], [x.score for x in own if not x.label]
            if not pos or not neg:
                assert r.roc_auc is None
                continue
            wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg) if len(pos) * len(neg) < 40_000 else None
            assert wins is None or r.roc_auc == pytest.approx(wins / (len(pos) * len(neg)))


def test_transfer_scores_one_scan_without_copies(spark):
    from inkprint.operators import transfer as TR

    rows = spark.range(400).select(
        F.col("id").cast("string").alias("id"),
        (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 2 == 0, "human").otherwise(F.concat(F.lit("m"), (F.col("id") % 3).cast("string"))).alias("source_model"),
        F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"),
        (F.col("id") % 7 + F.col("id") % 2).cast("double").alias("a"),
    )
    plan = plan_of(TR.training_rows(rows))
    assert len(re.findall(r"\+- \*?\(?\d*\)? ?Range|Range \(", plan)) <= 2


def test_stored_tables_go_when_the_session_ends(spark):
    from inkprint.storage import stored

    table = stored(spark.range(3).toDF("x"), "probe")
    assert table.count() == 3 and table.inputFiles()


def test_the_files_of_a_source_tree_are_written_by_many_tasks(spark, sf):
    paths = [r.path for r in Q._source_files(spark, sf).select("path").collect()]
    assert len(paths) == len({re.search(r"bucket=(\d+)", p).group(1) for p in paths}) > 2
    assert len({re.search(r"part-(\d+)", p).group(1) for p in paths}) > 1
