"""Arrow-batched helpers around the Python parser and tokenizer.

These are the only per-snippet Python functions of the feature path. Each parses one
snippet and hands back a small record; all arithmetic on top is done by Spark.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ast.parse and the tokenizer give up in these ways on text that is not Python
PARSE_ERRORS = (SyntaxError, ValueError, RecursionError, MemoryError)
TOKEN_ERRORS = (tokenize.TokenError, SyntaxError, ValueError, RecursionError, MemoryError)

# Abstract grammar classes and names kept only for old callers are never met in a tree.
_OBSOLETE = {
    "AugLoad", "AugStore", "Bytes", "Ellipsis", "ExtSlice", "Index", "NameConstant",
    "Num", "Param", "Str", "Suite", "slice",
}


def _node_vocabulary() -> list[str]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        classes = {n: getattr(ast, n) for n in dir(ast) if n not in _OBSOLETE and n[0] != "_"}
    nodes = {n: c for n, c in classes.items() if isinstance(c, type) and issubclass(c, ast.AST)}
    parents = {base for c in nodes.values() for base in c.__bases__}
    return sorted(n for n, c in nodes.items() if c not in parents)


OTHER_NODE = "__other__"
NODE_TYPES = [*_node_vocabulary(), OTHER_NODE]
NODE_INDEX = {name: i for i, name in enumerate(NODE_TYPES)}

FUNCTION_NODES = ("FunctionDef", "AsyncFunctionDef")
BRANCH_NODES = ("If", "For", "While")
TRY_NODES = ("Try",)
COMPREHENSION_NODES = ("ListComp", "DictComp", "SetComp", "GeneratorExp")
BLOCK_NODES = (*FUNCTION_NODES, "ClassDef")


def parse_or_none(code: str | None) -> ast.AST | None:
    if code is None:
        return None
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(code)
        except PARSE_ERRORS:
            return None


def decision_points(node: ast.AST) -> int:
    """McCabe weight a node adds to the block that owns it."""
    match node:
        case ast.If() | ast.IfExp() | ast.Assert() | ast.ExceptHandler():
            return 1
        case ast.For() | ast.AsyncFor() | ast.While():
            return 1 + bool(node.orelse)
        case ast.BoolOp():
            return len(node.values) - 1
        case ast.comprehension():
            return 1 + len(node.ifs)
        case _:
            return 0


def walk_rows(tree: ast.AST) -> Iterator[tuple[int, int | None, int, int | None, ast.AST]]:
    """Yield (node_id, parent_id, depth, block_id, node) in pre-order with an explicit stack."""
    stack: list[tuple[ast.AST, int | None, int, int | None]] = [(tree, None, 0, None)]
    node_id = 0
    while stack:
        node, parent, depth, block = stack.pop()
        own = node_id if type(node).__name__ in BLOCK_NODES else block
        yield node_id, parent, depth, own, node
        children = list(ast.iter_child_nodes(node))
        stack.extend((child, node_id, depth + 1, own) for child in reversed(children))
        node_id += 1


# --- node table ---------------------------------------------------------------------

_NODE_FIELDS = [
    ("node_id", pa.int32()),
    ("parent_id", pa.int32()),
    ("depth", pa.int32()),
    ("node_type", pa.string()),
    ("n_args", pa.int32()),
    ("decision_points", pa.int32()),
    ("block_id", pa.int32()),
]
NODE_COLUMNS = (
    "node_id int, parent_id int, depth int, node_type string, n_args int, "
    "decision_points int, block_id int"
)
_NODE_BATCH_ROWS = 50_000


def _node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.string()), *_NODE_FIELDS])

    def flush(rows):
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
        )

    rows: list[tuple] = []
    for batch in batches:
        for key, code in zip(batch.column("id").to_pylist(), batch.column("code").to_pylist()):
            tree = parse_or_none(code)
            if tree is None:
                continue
            for node_id, parent, depth, block, node in walk_rows(tree):
                kind = type(node).__name__
                n_args = len(node.args.args) if kind in FUNCTION_NODES else None
                rows.append(
                    (key, node_id, parent, depth, kind, n_args, decision_points(node), block)
                )
                if len(rows) >= _NODE_BATCH_ROWS:
                    yield flush(rows)
                    rows = []
    if rows:
        yield flush(rows)


def ast_node_table(df: DataFrame, id_col: str = "id", code: str = "code") -> DataFrame:
    """One row per syntax-tree node; a snippet that does not parse gives no row."""
    source = df.select(F.col(id_col).cast("string").alias("id"), F.col(code).alias("code"))
    return source.mapInArrow(_node_batches, f"id string, {NODE_COLUMNS}")


# --- one record per snippet ---------------------------------------------------------

_PROFILE = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("n_nodes", "depth", "n_args", "complexity", "n_blocks")]
    + [T.StructField("counts", T.ArrayType(T.IntegerType()))]
)


def _profile(code: str | None) -> tuple | None:
    tree = parse_or_none(code)
    if tree is None:
        return None
    counts = [0] * len(NODE_TYPES)
    deepest = args = complexity = blocks = 0
    for _, _, depth, block, node in walk_rows(tree):
        kind = type(node).__name__
        counts[NODE_INDEX.get(kind, NODE_INDEX[OTHER_NODE])] += 1
        deepest = max(deepest, depth)
        if kind in FUNCTION_NODES:
            args += len(node.args.args)
        if block is not None:
            complexity += decision_points(node) + (kind in BLOCK_NODES)
        blocks += kind in BLOCK_NODES
    return sum(counts), deepest, args, complexity, blocks, counts


@F.pandas_udf(_PROFILE)
def _ast_profile(codes: pd.Series) -> pd.DataFrame:
    names = _PROFILE.names
    rows = [_profile(c) or (None,) * len(names) for c in codes]
    return pd.DataFrame(rows, columns=names, dtype=object)


def ast_profile(code: Column) -> Column:
    """Per-snippet node counts by vocabulary position; null fields when it does not parse.

    This is the map-side combine of the node table: one tree is wholly inside one row, so
    features need no shuffle.
    """
    return _ast_profile(code)


# --- tokens -------------------------------------------------------------------------


def tokens_of(code: str) -> list[str]:
    try:
        found = tokenize.generate_tokens(io.StringIO(code).readline)
        return [t.string for t in found if not t.string.isspace() and t.string]
    except TOKEN_ERRORS:
        return code.split()


def entropy_of(text: str) -> float:
    if not text:
        return 0.0
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if points.max() < 65536:
        counts = np.bincount(points)
        counts = counts[counts > 0]
    else:
        counts = np.unique(points, return_counts=True)[1]
    share = counts / points.size
    return abs(float(-(share * np.log2(share)).sum()))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _py_tokens(codes: pd.Series) -> pd.Series:
    return codes.map(tokens_of, na_action="ignore")


def py_tokens(code: Column) -> Column:
    return _py_tokens(code)


_TOKEN_STATS = T.StructType(
    [
        T.StructField("char_entropy", T.DoubleType()),
        T.StructField("token_entropy", T.DoubleType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("unique_token_ratio", T.DoubleType()),
    ]
)


@F.pandas_udf(_TOKEN_STATS)
def _token_stats(codes: pd.Series) -> pd.DataFrame:
    def stats(code):
        if code is None:
            return None, None, None, None
        tokens = tokens_of(code)
        n = len(tokens)
        return (
            entropy_of(code),
            entropy_of(" ".join(tokens)),
            n,
            len(set(tokens)) / n if n else 0.0,
        )

    return pd.DataFrame([stats(c) for c in codes], columns=_TOKEN_STATS.names, dtype=object)


def token_stats(code: Column) -> Column:
    """Token counts and both entropies in one Arrow pass, so token text never returns."""
    return _token_stats(code)


_NAME = re.compile(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b")
_SPACES = np.array([i for i in range(0x3001) if chr(i).isspace()])

_SPACE_STATS = T.StructType(
    [
        *[T.StructField(n, T.DoubleType()) for n in ("name_avg_len", "name_snake_case_ratio", "name_single_char_ratio")],
        *_TOKEN_STATS.fields,
    ]
)


def _entropy_of_counts(counts: np.ndarray) -> float:
    counts = counts[counts > 0]
    share = counts / counts.sum()
    return abs(float(-(share * np.log2(share)).sum()))


def _space_stats_of(code: str | None) -> tuple:
    if code is None:
        return (None,) * len(_SPACE_STATS)
    names = _NAME.findall(code)
    n = len(names)
    snake = sum("_" in x and x == x.lower() for x in names)
    of_names = (sum(map(len, names)) / n, snake / n, sum(len(x) == 1 for x in names) / n) if n else (0.0, 0.0, 0.0)
    tokens = code.split()
    points = np.frombuffer(code.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if points.size and points.max() >= 65536:
        points = np.unique(np.r_[np.arange(0x3001), points], return_inverse=True)[1][0x3001:]  # lower code points stay
    counts = np.bincount(points, minlength=0x3001)
    of_text = _entropy_of_counts(counts) if points.size else 0.0
    # the tokens joined by single spaces
    counts[_SPACES] = 0
    counts[32] = max(len(tokens) - 1, 0)
    of_tokens = _entropy_of_counts(counts) if tokens else 0.0
    return *of_names, of_text, of_tokens, len(tokens), len(set(tokens)) / len(tokens) if tokens else 0.0


@F.pandas_udf(_SPACE_STATS)
def _space_stats(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_space_stats_of(c) for c in codes], columns=_SPACE_STATS.names, dtype=object)


def space_stats(code: Column) -> Column:
    """Names, and counts and both entropies of whitespace tokens, in one Arrow pass."""
    return _space_stats(code)


# --- function snippets --------------------------------------------------------------

FUNCTION_COLUMNS = "source_file string, position int, code string"


def function_segments(source: str) -> Iterator[str]:
    """Source text of every def / async def, breadth first, without decorators."""
    tree = parse_or_none(source)
    if tree is None:
        return
    # node columns are UTF-8 byte offsets, and only line feeds end a line here
    encoded = [line.encode() for line in source.split("\n")]
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            body = encoded[node.lineno - 1 : node.end_lineno]
            body[-1] = body[-1][: node.end_col_offset]
            body[0] = body[0][node.col_offset :]
            yield b"\n".join(body).decode()


def _function_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("source_file", pa.string()), ("position", pa.int32()), ("code", pa.string())]
    )
    for batch in batches:
        for path, source in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist()):
            found = list(function_segments(source or ""))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(found), pa.string()),
                        pa.array(range(len(found)), pa.int32()),
                        pa.array(found, pa.string()),
                    ],
                    schema=schema,
                )


def function_table(files: DataFrame) -> DataFrame:
    """(path, source) rows to one row per function; unparseable files give none."""
    return files.select("path", "source").mapInArrow(_function_batches, FUNCTION_COLUMNS)


@F.pandas_udf(T.StringType())
def _decode_utf8(contents: pd.Series) -> pd.Series:
    return contents.map(lambda b: bytes(b).decode("utf-8", "ignore"), na_action="ignore")


def decode_utf8(content: Column) -> Column:
    """UTF-8 text of a binary column; bytes that do not decode are dropped."""
    return _decode_utf8(content)


# --- renaming -----------------------------------------------------------------------


def rename_identifiers(code: str) -> str:
    """Every loaded or stored name becomes v0, v1, … in order of first visit.

    Parameters, function names and deleted names keep theirs, and the text is printed
    back from the tree, so comments and layout go too: not a semantics-preserving rename.
    """
    tree = parse_or_none(code)
    if tree is None:
        return code
    fresh: dict[str, str] = {}
    try:
        for _, _, _, _, node in walk_rows(tree):
            if not isinstance(node, ast.Name) or isinstance(node.ctx, ast.Del):
                continue
            if not node.id.startswith("__"):
                node.id = fresh.setdefault(node.id, f"v{len(fresh)}")
        return ast.unparse(tree)
    except PARSE_ERRORS:
        return code


@F.pandas_udf(T.StringType())
def _rename_variables(codes: pd.Series) -> pd.Series:
    return codes.map(rename_identifiers, na_action="ignore")


def rename_variables(code: Column) -> Column:
    return _rename_variables(code)
