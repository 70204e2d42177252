"""Feature extraction: syntax-tree features, style features, and the model's columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.functions import pysyntax as syntax
from inkprint.functions.text import STYLE_FEATURES, with_style_features
from inkprint.operators.corpus import META_COLUMNS, drop_null_code, meta_columns
from inkprint.operators.metrics import ratio

AST_COUNT_FEATURES = [
    "ast_parse_success",
    "ast_depth",
    "ast_n_nodes",
    "ast_n_functions",
    "ast_n_branches",
    "ast_n_try_except",
    "ast_n_comprehensions",
    "ast_avg_function_args",
    "ast_max_nesting",
    "ast_cyclomatic_complexity",
]
AST_FRACTION_FEATURES = [f"ast_frac_{name}" for name in syntax.NODE_TYPES]
FEATURES = [*AST_COUNT_FEATURES, *AST_FRACTION_FEATURES, *STYLE_FEATURES]


# --- grouped over the node table ----------------------------------------------------


def ast_counts(snippets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ten count features per id; snippets without nodes (parse failures) get zeros.

    All nodes of a snippet come out of one task, so the partial aggregation leaves one row
    per snippet to shuffle.
    """
    kind = F.col("node_type")

    def of(*names: str) -> Column:
        return F.count_if(kind.isin(*names))

    counted = nodes.groupBy("id").agg(
        F.lit(1.0).alias("ast_parse_success"),
        F.max("depth").alias("ast_depth"),
        F.count("*").alias("ast_n_nodes"),
        of(*syntax.FUNCTION_NODES).alias("ast_n_functions"),
        of(*syntax.BRANCH_NODES).alias("ast_n_branches"),
        of(*syntax.TRY_NODES).alias("ast_n_try_except"),
        of(*syntax.COMPREHENSION_NODES).alias("ast_n_comprehensions"),
        F.avg("n_args").alias("ast_avg_function_args"),
        # the definition gives this column no information: always zero
        F.lit(0.0).alias("ast_max_nesting"),
        _mean_complexity(
            F.sum(F.when(F.col("block_id").isNotNull(), F.col("decision_points"))),
            of(*syntax.BLOCK_NODES),
        ).alias("ast_cyclomatic_complexity"),
    )
    joined = snippets.join(counted, "id", "left").select(
        "id", *[F.col(c).cast("double").alias(c) for c in AST_COUNT_FEATURES]
    )
    return joined.na.fill(0.0, AST_COUNT_FEATURES)


def _mean_complexity(owned_points: Column, n_blocks: Column) -> Column:
    """Mean over blocks of 1 + the decision points each block owns; 0 without blocks."""
    return ratio(F.coalesce(owned_points, F.lit(0)) + n_blocks, n_blocks)


def cyclomatic_by_block(nodes: DataFrame) -> DataFrame:
    """Complexity of every function, method and class."""
    owned = nodes.where(F.col("block_id").isNotNull())
    return owned.groupBy("id", "block_id").agg(
        (F.sum("decision_points") + 1).alias("complexity")
    )


def mean_cyclomatic(snippets: DataFrame, nodes: DataFrame) -> DataFrame:
    per_id = (
        cyclomatic_by_block(nodes)
        .groupBy("id")
        .agg(F.avg("complexity").alias("ast_cyclomatic_complexity"))
    )
    return snippets.select("id").join(per_id, "id", "left").na.fill(0.0)


def ast_depth(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("id").agg(F.max("depth").alias("ast_depth"))


def node_fractions(nodes: DataFrame) -> DataFrame:
    """(id, node_type, n, fraction): share of each node type among the snippet's nodes."""
    per_type = nodes.groupBy("id", "node_type").agg(F.count("*").alias("n"))
    # a snippet has at most one row per node type here, and the trees are parsed once
    total = F.sum("n").over(Window.partitionBy("id"))
    return per_type.select("id", "node_type", "n", (F.col("n") / total).alias("fraction"))


def fraction_maps(nodes: DataFrame) -> DataFrame:
    """``ast_frac`` as one map per id; a snippet has at most one entry per node type."""
    entry = F.struct("node_type", "fraction")
    return (
        node_fractions(nodes)
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_list(entry)).alias("ast_frac"))
    )


# --- narrow, one pass per snippet ---------------------------------------------------


def with_ast_features(df: DataFrame, code: str = "code") -> DataFrame:
    """Append count and fraction features without a shuffle, from ``ast_profile``.

    Fractions are laid out over a fixed vocabulary, so the schema does not depend on data.
    """
    staged = df.withColumn("_ast", syntax.ast_profile(F.col(code)))

    def of(*names: str) -> str:
        found = " + ".join(f"_ast.counts[{syntax.NODE_INDEX[n]}]" for n in names)
        return f"coalesce({found}, 0)"

    def per(top: str, bottom: str) -> str:
        return f"coalesce(try_divide(cast({top} as double), cast({bottom} as double)), 0D)"

    # one SQL string per column: over a hundred columns, building Column objects call by
    # call costs seconds on the driver
    features = {
        "ast_parse_success": "_ast.n_nodes is not null",
        "ast_depth": "coalesce(_ast.depth, 0)",
        "ast_n_nodes": "coalesce(_ast.n_nodes, 0)",
        "ast_n_functions": of(*syntax.FUNCTION_NODES),
        "ast_n_branches": of(*syntax.BRANCH_NODES),
        "ast_n_try_except": of(*syntax.TRY_NODES),
        "ast_n_comprehensions": of(*syntax.COMPREHENSION_NODES),
        "ast_avg_function_args": per("_ast.n_args", of(*syntax.FUNCTION_NODES)),
        "ast_max_nesting": "0",
        "ast_cyclomatic_complexity": per("_ast.complexity", "_ast.n_blocks"),
    }
    for name, index in syntax.NODE_INDEX.items():
        features[f"ast_frac_{name}"] = per(f"_ast.counts[{index}]", "_ast.n_nodes")
    return staged.selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[f"cast({sql} as double) as `{name}`" for name, sql in features.items()],
    )


# Extension point: each extractor appends its columns to the rows it is given.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ast": with_ast_features,
    "style": with_style_features,
}


def with_features(
    df: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]] | None = None
) -> DataFrame:
    """All features appended to the rows, keeping their other columns; no shuffle."""
    for extract in (extractors or EXTRACTORS).values():
        df = extract(df)
    return df


def feature_matrix(df: DataFrame) -> DataFrame:
    """Meta columns that exist, then the features; missing values are 0."""
    rows = with_features(drop_null_code(df))
    names = [c for c in rows.columns if c not in df.columns]
    return align_features(rows, names, meta_columns(df))


def attach_features(meta: DataFrame, features: DataFrame) -> DataFrame:
    """Meta columns and separately stored features side by side, aligned by id."""
    keep = [c for c in features.columns if c == "id" or c not in META_COLUMNS]
    return meta.select(*meta_columns(meta)).join(features.select(*keep), "id")


def align_features(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the training columns in their order: missing become 0, others are dropped."""
    present = set(df.columns)
    aligned = [
        f"coalesce(cast(`{c}` as double), 0D) as `{c}`" if c in present else f"0D as `{c}`"
        for c in columns
    ]
    return df.selectExpr(*[f"`{c}`" for c in keep], *aligned)


def fill_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.fill(0.0, list(columns))
