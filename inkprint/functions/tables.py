"""Table functions over program text, for ``LATERAL`` in SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from inkprint.functions.pysyntax import FUNCTION_NODES, NODE_COLUMNS, decision_points, function_segments, parse_or_none, walk_rows


@udtf(returnType=NODE_COLUMNS, useArrow=True)
class AstNodes:
    """One row per syntax-tree node of a snippet; none where it does not parse."""

    def eval(self, code: str) -> Iterator[tuple]:
        tree = parse_or_none(code)
        if tree is not None:
            for node_id, parent, depth, block, node in walk_rows(tree):
                kind = type(node).__name__
                n_args = len(node.args.args) if kind in FUNCTION_NODES else None
                yield node_id, parent, depth, kind, n_args, decision_points(node), block


@udtf(returnType="position int, code string", useArrow=True)
class ExtractFunctions:
    """One row per function or method of a source text, in order; none where it does not parse."""

    def eval(self, source: str) -> Iterator[tuple]:
        yield from enumerate(function_segments(source or ""))


def register(spark: SparkSession) -> None:
    """``ast_nodes(code)`` and ``extract_functions(source)`` for this session's SQL."""
    spark.udtf.register("ast_nodes", AstNodes)
    spark.udtf.register("extract_functions", ExtractFunctions)
