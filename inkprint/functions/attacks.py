"""Text transformations that a detector should survive, as Column expressions.

Randomness is drawn from MD5 of (seed, id, line index): repeatable, and independent of
how rows are distributed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkprint.functions.pysyntax import rename_variables
from inkprint.functions.text import PY_SPACE_IN_LINE, lines, py_rstrip

_MAX32 = float(2**32)

Attack = Callable[[Column, Column, int], Column]


def draw(digest: Column, word: int) -> Column:
    """The word-th unsigned 32-bit integer of a hex digest."""
    return F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("bigint")


def strip_comments(code: Column) -> Column:
    """Drop lines whose first non-whitespace character is #."""
    kept = F.filter(lines(code), lambda line: ~line.rlike(rf"\A[{PY_SPACE_IN_LINE}]*+#"))
    return F.array_join(kept, "\n")


def reformat_whitespace(
    code: Column, id_col: Column, seed: int = 42, blank_share: float = 0.1
) -> Column:
    """Right-strip each line, add 0 to 2 spaces, and sometimes a blank line after it."""
    prefix = F.concat(F.lit(f"{seed}|"), id_col.cast("string"), F.lit("|"))

    def reformat(line: Column, index: Column) -> Column:
        digest = F.md5(F.concat(prefix, index.cast("string")))
        spaces = F.repeat(F.lit(" "), (draw(digest, 0) % 3).cast("int"))
        blank = F.when(draw(digest, 1) < F.lit(blank_share * _MAX32), "\n").otherwise("")
        return F.concat(py_rstrip(line), spaces, blank)

    return F.array_join(F.transform(lines(code), reformat), "\n")


# Extension point: name -> (code, id, seed) -> transformed code.
ATTACKS: dict[str, Attack] = {
    "none": lambda code, id_col, seed: code,
    "rename_vars": lambda code, id_col, seed: rename_variables(code),
    "strip_comments": lambda code, id_col, seed: strip_comments(code),
    "reformat_whitespace": lambda code, id_col, seed: reformat_whitespace(code, id_col, seed),
    "all_combined": lambda code, id_col, seed: reformat_whitespace(
        strip_comments(rename_variables(code)), id_col, seed
    ),
}


def attacked(
    attacks: dict[str, Attack], code: Column, id_col: Column, seed: int = 42
) -> Column:
    """Array of (attack, code): every attack on the text, the original where one gives null."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("attack"),
                F.coalesce(attack(code, id_col, seed), code).alias("code"),
            )
            for name, attack in attacks.items()
        ]
    )
