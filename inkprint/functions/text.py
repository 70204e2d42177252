"""Column expressions over snippet text. Everything here stays in the JVM.

Line-level counts are written as one regular expression over the whole text instead of
a split and a lambda per line: no array of lines is built, and the expression keeps
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 29 code points Python calls whitespace, as a regex class body.
PY_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The same without the line feed, for matches that must stay inside one line.
PY_SPACE_IN_LINE = r"\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

LINE_START = r"(?<![^\n])"
LINE_END = r"(?![^\n])"
# An identifier bounded as Python's Unicode-aware \b bounds it.
IDENTIFIER = r"(?<![\p{L}\p{N}_])[a-zA-Z_][a-zA-Z0-9_]*+(?![\p{L}\p{N}_])"

FENCE = "```"

STYLE_FEATURES = [
    "name_avg_len",
    "name_snake_case_ratio",
    "name_single_char_ratio",
    "comment_density",
    "docstring_count",
    "avg_comment_length",
    "trailing_whitespace_ratio",
    "mixed_indent_ratio",
    "blank_line_ratio",
    "line_length_std",
    "char_entropy",
    "token_entropy",
    "n_tokens",
    "unique_token_ratio",
]


def py_lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{PY_SPACE}]+", "")


def py_rstrip(c: Column) -> Column:
    # the lookbehind lets the match start only at the head of a whitespace run,
    # so a text with long inner runs is still scanned once
    return F.regexp_replace(c, rf"(?<![{PY_SPACE}])[{PY_SPACE}]++\z", "")


def py_strip(c: Column) -> Column:
    return py_rstrip(py_lstrip(c))


def is_nonblank(c: Column) -> Column:
    """True when the text holds a non-whitespace character; null text gives false."""
    return F.coalesce(c.rlike(rf"[^{PY_SPACE}]"), F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A column used several times in an expression is evaluated at each use inside lambdas
    and conditionals; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def n_lines(c: Column) -> Column:
    return count_of(c, "\n") + 1


def count_of(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    gone = F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))
    return (gone / len(needle)).cast("int")


def _matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _per_line(c: Column, pattern: str) -> Column:
    return _matches(c, pattern) / n_lines(c)


# --- naming -------------------------------------------------------------------------


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(0))


def _names(c: Column) -> Column:
    """All identifiers as one space-joined string: cheaper to count in than an array."""
    return F.array_join(identifiers(c), " ")


def _n_names(names: Column) -> Column:
    return F.when(names == "", 0).otherwise(count_of(names, " ") + 1)


def _share_of_names(names: Column, pattern: str) -> Column:
    n = _n_names(names)
    return F.when(n > 0, _matches(names, pattern) / n).otherwise(0.0)


def _name_avg_len(names: Column) -> Column:
    n = _n_names(names)
    return F.when(n > 0, (F.length(names) - n + 1) / n).otherwise(0.0)


def _snake_ratio(names: Column) -> Column:
    return _share_of_names(names, r"(?<![^ ])(?=[a-z0-9]*_)[a-z0-9_]++(?![^ ])")


def _single_char_ratio(names: Column) -> Column:
    return _share_of_names(names, r"(?<![^ ])[^ ](?![^ ])")


def name_avg_len(c: Column) -> Column:
    return let(_names(c), _name_avg_len)


def name_snake_case_ratio(c: Column) -> Column:
    return let(_names(c), _snake_ratio)


def name_single_char_ratio(c: Column) -> Column:
    return let(_names(c), _single_char_ratio)


# --- comments -----------------------------------------------------------------------


def comment_density(c: Column) -> Column:
    return _per_line(c, rf"{LINE_START}[{PY_SPACE_IN_LINE}]*+#")


def docstring_count(c: Column) -> Column:
    return (count_of(c, '"""') + count_of(c, "'''")) / n_lines(c)


def avg_comment_length(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(rf"{LINE_START}[{PY_SPACE_IN_LINE}]*+#[^\n]*+"), F.lit(0))

    def bare_length(line: Column) -> Column:
        return F.length(py_strip(F.regexp_replace(line, r"\A[# ]+|(?<![# ])[# ]++\z", "")))

    total = F.aggregate(F.transform(found, bare_length), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(found) > 0, total / F.size(found)).otherwise(0.0)


# --- layout -------------------------------------------------------------------------


def trailing_whitespace_ratio(c: Column) -> Column:
    # the end of the line first: few places pass it, and only these are asked for whitespace
    return _per_line(c, rf"{LINE_END}(?<=[{PY_SPACE_IN_LINE}])")


def mixed_indent_ratio(c: Column) -> Column:
    return _per_line(c, rf"{LINE_START} [^\n\t]*+\t")


def blank_line_ratio(c: Column) -> Column:
    return _per_line(c, rf"{LINE_START}[{PY_SPACE_IN_LINE}]*+{LINE_END}")


def line_length_std(c: Column) -> Column:
    """Population standard deviation of line lengths, in two passes."""

    def spread_of(lengths: Column) -> Column:
        n = F.size(lengths)
        total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
        squares = let(
            total / n,
            lambda mean: F.aggregate(
                lengths, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)
            ),
        )
        return F.sqrt(squares / n)

    return let(F.transform(lines(c), F.length), spread_of)


# --- entropy and tokens -------------------------------------------------------------


def _char_runs(c: Column) -> Column:
    """The characters in sorted order, cut into runs of equal ones.

    The cost is n log n whatever the number of distinct characters. The possessive
    quantifier keeps the matcher iterative on runs of any length.
    """
    ordered = F.array_join(F.sort_array(F.split(c, "")), "")
    return F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*+"), F.lit(0))


def _weighted_log(runs: Column) -> Column:
    """Sum of k log2 k over run lengths k."""
    sizes = F.transform(runs, lambda r: F.length(r).cast("double"))
    return F.aggregate(sizes, F.lit(0.0), lambda a, k: a + k * F.log2(k))


def _entropy(weighted_log: Column, n: Column) -> Column:
    return F.when(n > 0, F.greatest(F.log2(n) - weighted_log / n, F.lit(0.0))).otherwise(0.0)


def char_entropy(c: Column) -> Column:
    """Base-2 Shannon entropy of the characters."""
    return let(c, lambda text: _entropy(_weighted_log(_char_runs(text)), F.length(text)))


def space_token_entropy(runs: Column, n_tokens: Column) -> Column:
    """Entropy of the whitespace tokens joined by single spaces, from the runs of the text:
    the joined characters are those of the text without whitespace, plus the spaces."""
    inked = F.filter(runs, lambda r: ~r.rlike(rf"\A[{PY_SPACE}]"))
    gaps = F.greatest(n_tokens - 1, F.lit(0)).cast("double")
    n = F.aggregate(inked, F.lit(0), lambda a, r: a + F.length(r)) + gaps
    gap_term = F.when(gaps > 0, gaps * F.log2(gaps)).otherwise(0.0)
    return let(_weighted_log(inked) + gap_term, lambda w: let(n, lambda m: _entropy(w, m)))


def space_tokens(c: Column) -> Column:
    """Whitespace-separated tokens, as str.split() without arguments gives them."""
    return F.array_remove(F.split(c, rf"[{PY_SPACE}]+"), "")


def unique_ratio(tokens: Column) -> Column:
    def share(t: Column) -> Column:
        return F.when(F.size(t) > 0, F.size(F.array_distinct(t)) / F.size(t)).otherwise(0.0)

    return let(tokens, share)


def _line_features(c: Column) -> dict[str, Column]:
    return {
        "comment_density": comment_density(c),
        "docstring_count": docstring_count(c),
        "avg_comment_length": avg_comment_length(c),
        "trailing_whitespace_ratio": trailing_whitespace_ratio(c),
        "mixed_indent_ratio": mixed_indent_ratio(c),
        "blank_line_ratio": blank_line_ratio(c),
        "line_length_std": line_length_std(c),
    }


# features that are 0 for a null text and come from one Arrow pass, if wanted
_ARROW_FEATURES = {
    "name_avg_len",
    "name_snake_case_ratio",
    "name_single_char_ratio",
    "char_entropy",
    "token_entropy",
    "unique_token_ratio",
}


def with_style_features(df: DataFrame, code: str = "code", tokens: str = "python") -> DataFrame:
    """Append the 14 style features.

    ``tokens="python"`` takes token counts and both entropies from one Arrow pass over the
    text (the tokenizer needs Python anyway); ``tokens="space"`` is the tokenizer's
    fallback for every row and has no Python node in its plan; ``tokens="arrow"`` gives the same
    values, with those of names, tokens and characters from one Arrow pass, in about half the time.
    """
    c = F.col(code)
    if tokens == "arrow":
        from inkprint.functions.pysyntax import space_stats

        staged = df.withColumn("_tok", space_stats(c))
        of_null = {name: F.coalesce(f"_tok.{name}", F.lit(0.0)) for name in STYLE_FEATURES if name in _ARROW_FEATURES}
        features = {**_line_features(c), **of_null, "n_tokens": F.col("_tok.n_tokens")}
        return staged.withColumns({k: features[k].cast("double") for k in STYLE_FEATURES}).drop("_tok")
    if tokens == "python":
        from inkprint.functions.pysyntax import token_stats

        staged = df.withColumns({"_names": _names(c), "_tok": token_stats(c)})
        tail = {
            "char_entropy": F.col("_tok.char_entropy"),
            "token_entropy": F.col("_tok.token_entropy"),
            "n_tokens": F.col("_tok.n_tokens"),
            "unique_token_ratio": F.col("_tok.unique_token_ratio"),
        }
    elif tokens == "space":
        staged = df.withColumns(
            {"_names": _names(c), "_tok": space_tokens(c), "_runs": _char_runs(c)}
        )
        tail = {
            "char_entropy": _entropy(_weighted_log(F.col("_runs")), F.length(c)),
            "token_entropy": space_token_entropy(F.col("_runs"), F.size("_tok")),
            "n_tokens": F.size("_tok"),
            "unique_token_ratio": unique_ratio(F.col("_tok")),
        }
    else:
        raise ValueError(f"tokens must be 'python', 'space' or 'arrow', not {tokens!r}")
    names = F.col("_names")
    features = {
        "name_avg_len": _name_avg_len(names),
        "name_snake_case_ratio": _snake_ratio(names),
        "name_single_char_ratio": _single_char_ratio(names),
        **_line_features(c),
        **tail,
    }
    return staged.withColumns({k: v.cast("double") for k, v in features.items()}).drop(
        "_names", "_tok", "_runs"
    )


# --- identifiers, prompts and fences ------------------------------------------------


def length_band(c: Column, low: int = 5, high: int = 120) -> Column:
    return n_lines(c).between(low, high)


def content_id(c: Column, prefix: str = "human_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(c), 1, 12))


def composite_id(problem: Column, language: Column, model: Column) -> Column:
    return F.concat(problem, F.lit("_"), language, F.lit("_"), model)


# The three constant parts of the generation prompt.
PROMPT_PARTS = (
    "Write a ",
    " solution to the following problem.\n"
    "Return ONLY the code, no explanations, no markdown fences.\n\nProblem:\n",
    "\n",
)


def render_prompt(language: Column, statement: Column) -> Column:
    head, middle, tail = map(F.lit, PROMPT_PARTS)
    return F.concat(head, language, middle, statement, tail)


def strip_code_fence(c: Column) -> Column:
    """Strip, drop an opening fence line, then a closing one if it is the last line."""
    text = py_strip(c)
    body = F.regexp_replace(text, rf"\A{FENCE}[^\n]*+(?:\n|\z)", "")
    body = F.regexp_replace(body, rf"{LINE_START}[{PY_SPACE_IN_LINE}]*+{FENCE}[^\n]*+\z", "")
    return F.when(F.startswith(text, F.lit(FENCE)), py_strip(body)).otherwise(text)
