"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions import pysyntax, tables, text
from inkprint.functions.attacks import reformat_whitespace, strip_comments
from inkprint.operators import corpus as C
from inkprint.operators import detectors as D
from inkprint.operators import ensemble as E
from inkprint.operators import explain as X
from inkprint.operators import features as FE
from inkprint.operators import kneser_ney as KN
from inkprint.operators import likelihood as L
from inkprint.operators import metrics as M
from inkprint.operators import ranking as R
from inkprint.operators import robustness as RB
from inkprint.operators import score as S
from inkprint.operators import transfer as TR
from inkprint.plans import views as V
from inkprint.plans.views import rounded
from inkprint.sources import files
from inkprint.storage import new_path, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- shared inputs ------------------------------------------------------------------

_KEPT: dict[tuple, object] = {}


def _once(spark: SparkSession, sf: str, name: str, build: Callable[[], object]):
    """A stored table or fitted model that several queries of one session start from."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def _split_snippets(spark, sf):
    return R.stratified_split(V.snippets(spark, sf))


def _split_docs(spark, sf):
    return R.stratified_split(V.labelled_docs(spark, sf))


def _code_features(spark, sf):
    return _once(
        spark,
        sf,
        "features",
        lambda: stored(FE.feature_matrix(V.code_dataset(spark, sf)), "features"),
    )


def _code_model(spark, sf):
    def fit():
        train = C.in_split(_code_features(spark, sf), "train")
        return D.fit_pipeline(D.boosted_trees(), FE.FEATURES, train)

    return _once(spark, sf, "model", fit)


def _planted_features(spark, sf):
    return _once(
        spark,
        sf,
        "planted-features",
        lambda: stored(FE.feature_matrix(V.planted_dataset(spark, sf)), "features"),
    )


def _planted_model(spark, sf):
    def fit():
        train = C.in_split(_planted_features(spark, sf), "train")
        return D.fit_pipeline(D.boosted_trees(), FE.FEATURES, train)

    return _once(spark, sf, "planted-model", fit)


def _predicted(spark, sf):
    return V.scored(spark, sf).withColumn("prediction", M.threshold_prediction(F.col("score")))


def _grid(spark, sf):
    return C.prompt_grid(V.problems(spark, sf), V.LANGUAGES, V.MODELS)


def _requests(spark, sf):
    return C.generate_requests(V.problems(spark, sf), V.LANGUAGES, V.MODELS, V.DISPATCH)


def _completions(spark, sf):
    return V.completions(spark, sf, _requests(spark, sf))


def _union(spark, sf):
    return C.union_sources(*V.raw_sources(spark, sf))


def _records(spark, sf):
    return V.code_corpus(spark, sf).drop("k")


def _bigrams(spark, sf):
    def fit():
        return L.fit_bigrams(C.in_split(_split_snippets(spark, sf), "train"))

    return _once(spark, sf, "bigrams", fit)


def _nodes(spark, sf):
    return pysyntax.ast_node_table(V.code_corpus(spark, sf))


def _matrix_text(name: str = "confusion_matrix"):
    return F.to_json(name).alias(name)


# --- sources and sinks --------------------------------------------------------------


@query
def scan_problems(spark, sf):
    """JSON arrays of a hundred problems each, one array per file."""
    path = new_path(spark, "problems")
    chunk = F.floor(F.col("id").cast("bigint") / 100).alias("chunk")
    arrays = V.problems(spark, sf).groupBy(chunk).agg(
        F.to_json(F.collect_list(F.struct("id", "statement"))).alias("value")
    )
    arrays.repartition("chunk").write.partitionBy("chunk").text(path)
    return files.read_problems(spark, path)


@query
def scan_jsonl(spark, sf):
    path = new_path(spark, "jsonl")
    files.write_jsonl(_records(spark, sf), path)
    return files.read_jsonl(spark, path).select("id", "label", "source_model", "language", "code")


# of the programs, about a hundred of which are a file
_ROWS_PER_WRITER = 10_000


def _source_files(spark, sf):
    def build():
        path = new_path(spark, "sources")
        rows = V.code_corpus(spark, sf)
        key = F.col("id").cast("bigint")
        rows = rows.withColumn("bucket", F.floor(key / 600) * 6 + F.col("k")).withColumn("key", key)
        # opening a file takes far longer than filling it: the tasks follow the number of files, not their few bytes
        tasks = max(spark.sparkContext.defaultParallelism, V.table(spark, sf, "part").count() // _ROWS_PER_WRITER)
        (
            rows.repartition(tasks, "bucket")
            .sortWithinPartitions("bucket", "key")
            .select("bucket", F.col("code").alias("value"))
            # tasks put their files in place themselves; nobody knows the folder until all of them have
            .write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
            .partitionBy("bucket")
            .text(path)
        )
        return path

    path = _once(spark, sf, "source-tree", build)
    return files.read_source_tree(spark, path, glob="*.txt")


def _bucket(column: str):
    return F.regexp_extract(column, r"bucket=(\d+)", 1).cast("bigint").alias("bucket")


@query
def scan_source_tree(spark, sf):
    return _source_files(spark, sf).select(_bucket("path"), "source")


@query
def write_jsonl(spark, sf):
    path = new_path(spark, "jsonl")
    rows = _records(spark, sf).select(
        "id",
        F.lit(None).cast("string").alias("problem_id"),
        "language",
        "source_model",
        "label",
        "code",
        F.lit(None).cast("string").alias("source_file"),
    )
    files.write_jsonl(rows, path)
    lines = spark.read.text(path)
    return lines.select(
        F.get_json_object("value", "$.id").alias("id"),
        F.get_json_object("value", "$.code").alias("code"),
        F.size(F.json_object_keys("value")).alias("n_keys"),
    )


@query
def csv_roundtrip(spark, sf):
    path = new_path(spark, "csv")
    rows = _records(spark, sf).select("id", "label", "source_model", "language", "code")
    files.write_csv(rows, path)
    schema = "id string, label int, source_model string, language string, code string"
    return files.read_csv(spark, path, schema)


@query
def model_bundle_io(spark, sf):
    path = new_path(spark, "model")
    files.save_model(_code_model(spark, sf), path)
    before = D.with_probability(_code_model(spark, sf).transform(_code_features(spark, sf)), "_before")
    kept = before.drop("features", "rawPrediction", "probability", "prediction")
    scored = D.with_probability(files.load_model(path).transform(kept))
    return rounded(scored.select("id", "label", (F.col("score") - F.col("_before")).alias("difference")))


@query
def metrics_sink(spark, sf):
    path = new_path(spark, "metrics")
    metrics = M.evaluate(V.scored(spark, sf), ["model"])
    files.write_metrics(metrics, path)
    read = spark.read.schema(metrics.schema).json(path)
    return rounded(read.withColumn("confusion_matrix", _matrix_text()))


@query
def matrix_sink(spark, sf):
    path = new_path(spark, "matrix")
    cells = M.roc_auc(V.scored(spark, sf), ["model", "lang"]).select(
        F.col("model").alias("train_model"), F.col("lang").alias("test_model"), "roc_auc"
    )
    # one column per language of the data
    languages = sorted(r[0] for r in cells.select("test_model").distinct().collect())
    files.write_matrix(files.transfer_matrix(rounded(cells), languages), path)
    schema = ", ".join(["train_model string", *[f"`{x}` double" for x in languages]])
    return spark.read.schema(schema).option("header", True).csv(path)


# --- projections and filters --------------------------------------------------------


@query
def nonblank_filter(spark, sf):
    return C.nonblank(_union(spark, sf)).select("id", "label", "code")


@query
def dropna_code(spark, sf):
    return C.drop_null_code(_union(spark, sf)).select("id", "label", "code")


@query
def split_filter(spark, sf):
    return C.in_split(_split_snippets(spark, sf), "test").select("id", "label", "code")


@query
def feature_projection(spark, sf):
    rows = style_vector(spark, sf)
    return rows.select(*C.feature_columns(rows))


@query
def meta_projection(spark, sf):
    rows = _split_snippets(spark, sf)
    return rows.select(*C.meta_columns(rows))


@query
def code_label_projection(spark, sf):
    return C.in_split(_split_snippets(spark, sf), "val").select("code", "label")


@query
def length_band_filter(spark, sf):
    return V.texts(spark, sf).where(text.length_band(F.col("code"))).select("id", "code")


@query
def content_id(spark, sf):
    return V.texts(spark, sf).select("id", text.content_id(F.col("code")).alias("content_id"))


@query
def composite_id(spark, sf):
    key = text.composite_id(F.col("id"), F.col("language"), F.col("source_model"))
    return _grid(spark, sf).select(key.alias("id"))


@query
def render_prompt(spark, sf):
    prompt = text.render_prompt(F.col("language"), F.col("statement"))
    return _grid(spark, sf).select("id", "language", "source_model", prompt.alias("prompt"))


@query
def strip_code_fence(spark, sf):
    return _completions(spark, sf).select(
        "id", text.strip_code_fence(F.col("completion")).alias("code")
    )


@query
def known_model_filter(spark, sf):
    dispatch = spark.createDataFrame([(m,) for m in V.DISPATCH], "source_model string")
    return C.known_models(_grid(spark, sf), dispatch).select("id", "language", "source_model")


@query
def label_tagging(spark, sf):
    tagged = C.tag_source(V.texts(spark, sf), 0, "human", "python")
    return tagged.select("id", "code", "label", "source_model", "language")


@query
def fill_missing_features(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id")
    rows = docs.join(V.table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("double").alias("toxic"),
    )
    return FE.fill_missing(rows, ["quality", "toxic"])


@query
def align_features(spark, sf):
    rows = text.with_style_features(V.texts(spark, sf), tokens="space")
    wanted = ["n_tokens", "ast_frac_Name", "name_avg_len", "ast_depth"]
    return rounded(FE.align_features(rows, wanted, ["id"]))


@query
def threshold_verdict(spark, sf):
    score = F.col("score")
    return V.scored(spark, sf).select(
        "id",
        M.threshold_prediction(score).alias("prediction"),
        S.verdict(score).alias("verdict"),
        S.confidence(score).alias("confidence"),
    )


@query
def impact_direction(spark, sf):
    rows, names = V.contributions(spark, sf)
    long = X.long_contributions(rows, names)
    reason = X.impact_text(F.col("feature"), F.col("impact"))
    return long.select("id", "feature_ix", reason.alias("reason"))


# --- joins --------------------------------------------------------------------------


@query
def prompt_grid(spark, sf):
    return _grid(spark, sf).select("id", "language", "source_model")


@query
def model_pair_grid(spark, sf):
    docs = V.labelled_docs(spark, sf)
    return TR.pair_grid(docs)


@query
def attack_grid(spark, sf):
    rows = RB.attack_rows(V.code_corpus(spark, sf))
    return rows.select("id", "attack", F.md5("code").alias("code_md5"))


@query
def perturbation_grid(spark, sf):
    return L.perturbations(V.snippets(spark, sf)).select("id", "round")


@query
def attach_features(spark, sf):
    rows = _split_snippets(spark, sf)
    style = text.with_style_features(V.snippets(spark, sf), tokens="arrow")
    features = style.select("id", *text.STYLE_FEATURES)
    return rounded(FE.attach_features(rows, features))


@query
def merge_scores(spark, sf):
    docs = _split_docs(spark, sf)
    baseline = V.scored(spark, sf).select("id", "score")
    lexical = docs.select("id", (F.length("code") % 89 / F.lit(89.0)).alias("score"))
    likelihood = V.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), (F.col("n_chars") % 83 / F.lit(83.0)).alias("score")
    )
    return rounded(E.merge_scores(docs, baseline, lexical, likelihood))


@query
def attach_completions(spark, sf):
    return C.attach_completions(_requests(spark, sf), _completions(spark, sf))


# --- aggregations -------------------------------------------------------------------


@query
def class_counts(spark, sf):
    return C.class_counts(_union(spark, sf))


@query
def split_label_counts(spark, sf):
    return C.split_label_counts(_split_snippets(spark, sf))


@query
def distinct_source_models(spark, sf):
    return C.distinct_source_models(V.labelled_docs(spark, sf))


@query
def dedup_keep_first(spark, sf):
    return C.dedup_keep_first(_union(spark, sf)).select("id", "label", "source_model", "code")


@query
def binary_metrics(spark, sf):
    return rounded(M.binary_metrics(_predicted(spark, sf), ["model"]).drop("confusion_matrix"))


@query
def roc_auc(spark, sf):
    return rounded(M.roc_auc(V.scored(spark, sf), ["model"]))


@query
def confusion_matrix(spark, sf):
    counts = M.confusion_counts(_predicted(spark, sf), ["model"])
    return counts.select("*", F.to_json(M.confusion_matrix()).alias("matrix"))


@query
def classification_report(spark, sf):
    return rounded(M.classification_report(_predicted(spark, sf), ["model"]))


@query
def population_guard(spark, sf):
    return TR.guarded_grid(_split_docs(spark, sf))


@query
def ast_counts(spark, sf):
    return rounded(FE.ast_counts(V.code_corpus(spark, sf).select("id"), _nodes(spark, sf)))


@query
def ast_node_fractions(spark, sf):
    return rounded(FE.node_fractions(_nodes(spark, sf)))


@query
def ast_depth(spark, sf):
    return FE.ast_depth(_nodes(spark, sf))


@query
def cyclomatic(spark, sf):
    return rounded(FE.mean_cyclomatic(V.code_corpus(spark, sf), _nodes(spark, sf)))


@query
def perturbation_stats(spark, sf):
    scores = L.perturbed_likelihood(V.snippets(spark, sf), _bigrams(spark, sf))
    return rounded(L.perturbation_stats(scores.where("round > 0")))


@query
def global_importance(spark, sf):
    rows, names = V.contributions(spark, sf)
    return rounded(X.global_importance(rows, names))


# --- ordering and sampling ----------------------------------------------------------


@query
def stratified_split(spark, sf):
    return _split_snippets(spark, sf).select("id", "label", "split")


def _sample(spark, sf):
    test = C.drop_null_code(C.in_split(_split_snippets(spark, sf), "test"))
    return R.seeded_sample(test, 200)


@query
def seeded_sample(spark, sf):
    return _sample(spark, sf).select("id", "label")


@query
def top_importances(spark, sf):
    # all rows and columns for each tree: the first column that tells the labels apart takes every split
    train = C.in_split(_planted_features(spark, sf), "train")
    model = D.fit_pipeline(D.boosted_trees(rows=1.0, columns=1.0), FE.FEATURES, train)
    return rounded(D.top_importances(model, spark))


@query
def topk_contributions(spark, sf):
    rows, names = V.contributions(spark, sf)
    return rounded(rows.select("id", F.inline(X.top_contributions(F.col("shap"), names))))


@query
def limit_snippets(spark, sf):
    rows = _human_snippets(spark, sf)
    rows = rows.withColumn("source_file", F.lpad(rows.bucket.cast("string"), 9, "0"))
    return C.limit_snippets(rows, 100).select("id", "bucket")


@query
def median_threshold(spark, sf):
    judged = M.median_predictions(V.scored(spark, sf), "score", ["model"])
    return rounded(judged.select("id", "model", "threshold", "prediction"))


# --- set operations -----------------------------------------------------------------


@query
def union_sources(spark, sf):
    return _union(spark, sf).select("id", "label", "source_model", "src_ord", "code")


@query
def union_splits(spark, sf):
    return _split_snippets(spark, sf).select("id", "label", "split", "code")


@query
def union_train_eval(spark, sf):
    docs = _split_docs(spark, sf).where("split <> 'val'")
    return TR.training_rows(docs).select("model", "split", "id", "label")


# --- style features -----------------------------------------------------------------


def _style_query(name: str) -> Query:
    def run(spark, sf):
        return style_vector(spark, sf).select("id", name)

    run.__name__ = name
    return run


for _name in text.STYLE_FEATURES:
    query(_style_query(_name))


@query
def style_vector(spark, sf):
    rows = text.with_style_features(V.texts(spark, sf), tokens="arrow")
    return rounded(rows.select("id", *text.STYLE_FEATURES))


@query
def feature_matrix(spark, sf):
    return rounded(FE.feature_matrix(V.code_dataset(spark, sf)))


# --- transforms and jobs ------------------------------------------------------------


def _human_snippets(spark, sf):
    found = C.human_snippets(pysyntax.function_table(_source_files(spark, sf)))
    return found.withColumn("bucket", _bucket("source_file"))


@query
def extract_functions(spark, sf):
    return _human_snippets(spark, sf).select(
        "id", "language", "source_model", "label", "code", "bucket"
    )


@query
def ast_nodes_lateral(spark, sf):
    """The node table by a table function in SQL."""
    tables.register(spark)
    V.code_corpus(spark, sf).createOrReplaceTempView("_snippets")
    return spark.sql("SELECT id, node_type, count(*) AS n FROM _snippets, LATERAL ast_nodes(code) GROUP BY id, node_type")


@query
def extract_functions_lateral(spark, sf):
    """The functions of source files by a table function in SQL."""
    tables.register(spark)
    _source_files(spark, sf).withColumn("bucket", _bucket("path")).createOrReplaceTempView("_sources")
    return spark.sql("SELECT bucket, f.code FROM _sources, LATERAL extract_functions(source) AS f")


@query
def ast_node_table(spark, sf):
    return _nodes(spark, sf).groupBy("id", "node_type").agg(F.count("*").alias("n"))


@query
def attack_rename_vars(spark, sf):
    renamed = pysyntax.rename_variables(F.col("code"))
    return V.code_corpus(spark, sf).select("id", renamed.alias("code"))


@query
def attack_strip_comments(spark, sf):
    return V.texts(spark, sf).select("id", strip_comments(F.col("code")).alias("code"))


@query
def attack_reformat_whitespace(spark, sf):
    code = reformat_whitespace(F.col("code"), F.col("id"))
    return V.texts(spark, sf).select("id", code.alias("code"))


@query
def attack_registry(spark, sf):
    return RB.attack_rows(V.code_corpus(spark, sf)).select("id", "attack", "code")


@query
def train_baselines(spark, sf):
    features = _planted_features(spark, sf)
    fitted = {"boosted_trees": _planted_model(spark, sf)}
    _, metrics = D.train_baselines(features, FE.FEATURES, kernel={}, fitted=fitted)
    return rounded(metrics.withColumn("confusion_matrix", _matrix_text()))


@query
def lexical_classifier(spark, sf):
    dataset = V.planted_dataset(spark, sf).select("id", "label", "split", "code")
    _, metrics = D.train_lexical(dataset)
    return rounded(metrics.withColumn("confusion_matrix", _matrix_text()))


@query
def ngram_log_likelihood(spark, sf):
    return rounded(L.log_likelihood(V.snippets(spark, sf), _bigrams(spark, sf)))


@query
def kneser_ney_likelihood(spark, sf):
    model = KN.fit_ngrams(C.in_split(_split_snippets(spark, sf), "train"), order=3)
    return rounded(KN.log_likelihood(V.snippets(spark, sf), model))


@query
def perplexity(spark, sf):
    scores = L.log_likelihood(V.snippets(spark, sf), _bigrams(spark, sf))
    return rounded(scores.select("id", L.perplexity(F.col("ll")).alias("perplexity")))


@query
def perturb(spark, sf):
    return L.perturbations(V.snippets(spark, sf))


@query
def curvature_score(spark, sf):
    scores = L.curvature(V.snippets(spark, sf), _bigrams(spark, sf))
    return rounded(scores.withColumn("score", F.round("score", 4)))


@query
def zero_shot_eval(spark, sf):
    result = L.zero_shot_eval(_split_snippets(spark, sf), _bigrams(spark, sf))
    return rounded(result.withColumn("threshold", F.round("threshold", 4)))


@query
def robustness_eval(spark, sf):
    # fitted on style alone under the labels that programs decide; tested under labels some of which are turned around
    train = C.in_split(_planted_features(spark, sf), "train")
    model = D.fit_pipeline(D.boosted_trees(rows=1.0, columns=1.0), text.STYLE_FEATURES, train)
    return rounded(RB.robustness(model, V.code_dataset(spark, sf)))


@query
def cross_model_matrix(spark, sf):
    features = _planted_features(spark, sf)
    return rounded(TR.transfer_auc(features, FE.FEATURES))


@query
def stack_ensemble(spark, sf):
    dataset = V.planted_dataset(spark, sf)
    model = _planted_model(spark, sf)
    baseline = D.with_probability(model.transform(_planted_features(spark, sf))).select("id", "score")
    lexical, _ = D.train_lexical(dataset.select("id", "label", "split", "code"))
    bigrams = L.fit_bigrams(C.in_split(dataset, "train"))
    curved = L.curvature(dataset.select("id", "code"), bigrams).select("id", "score")
    merged = E.merge_scores(dataset, baseline, D.score_lexical(lexical, dataset), curved)
    _, metrics = E.train_ensemble(stored(merged, "merged-scores"))
    return rounded(metrics.withColumn("confusion_matrix", _matrix_text()))


@query
def tree_shap(spark, sf):
    model = _code_model(spark, sf)
    test = C.in_split(_code_features(spark, sf), "test")
    scored = X.with_attributions(D.with_probability(model.transform(test)), model)
    total = F.aggregate("shap", F.col("base_value"), lambda a, x: a + x)
    log_odds = F.log(F.col("score") / (1 - F.col("score")))
    return rounded(scored.select("id", F.size("shap").alias("n_shares"), (total - log_odds).alias("gap")))


@query
def score_snippets(spark, sf):
    scored = S.score_snippets(V.code_corpus(spark, sf, flips=False), _planted_model(spark, sf))
    sure = (F.col("confidence") == S.confidence(F.col("score"))).alias("confidence_fits")
    return scored.select("id", "prediction", "verdict", sure, F.size("reasons").alias("n_reasons"), "unit")


@query
def prepare_dataset(spark, sf):
    dataset = C.prepare_dataset(*V.raw_sources(spark, sf))
    return dataset.select("id", "label", "source_model", "split", "code")


@query
def generate_requests(spark, sf):
    return _requests(spark, sf)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Prepare the dataset, then average the style features per split and label."""
    dataset = C.prepare_dataset(*V.raw_sources(spark, sf))
    styled = text.with_style_features(files.spread(dataset, "id"), tokens="arrow")
    averages = [F.avg(c).alias(c) for c in text.STYLE_FEATURES]
    return rounded(styled.groupBy("split", "label").agg(F.count("*").alias("n"), *averages))
