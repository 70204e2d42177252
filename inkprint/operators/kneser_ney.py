"""N-gram likelihood with modified Kneser-Ney smoothing (Chen and Goodman 1999), by joins and aggregates.

The model is two written tables per order: counts of grams, and the mass each context leaves to the next shorter one. Scoring meets
each of them in one join, from the shortest context up; shorter windows are priced once each. Rows of frequent keys meet a broadcast of a bounded
number of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from inkprint.functions.text import space_tokens
from inkprint.operators.likelihood import HOT_PAIRS
from inkprint.storage import stored

ORDER = 5
# longer keys are never broadcast, so that the tables sent to tasks stay small
_HOT_CHARS = 64
# rows of one hot key are dealt over so many keys
_SPREAD = 4_096
# what a discount of counts 1, 2, 3 and more may be, as shares of the count, and what it is where counts say nothing
_LEAST, _MOST, _UNKNOWN = 0.1, 0.9, 0.5
# equal texts must have exactly equal scores, whatever order their terms were added in
_SCORE_DIGITS = 12


@dataclass(frozen=True)
class NgramModel:
    """Per order from 1: grams(h, w, c), contexts(h, n, b), the discounts of counts 1, 2, 3 and more, and the sum of all counts.

    ``unseen`` is the probability of any one word without counts.
    """

    grams: list[DataFrame]
    contexts: list[DataFrame]
    taken: list[list[float]]
    totals: list[int]
    unseen: float

    @property
    def order(self) -> int:
        return len(self.grams)


def _windows(df: DataFrame, keys: list[Column], code: str, order: int) -> DataFrame:
    """(keys, i, h, w) of every token: its number from 0, the ``order`` - 1 tokens before it joined by blanks, and itself.

    Empty tokens stand before the text; no token is empty or holds a blank, so a joined context can be taken apart.
    """
    tokens = df.select(*keys, space_tokens(F.col(code)).alias("_t"))
    before = [F.slice(F.concat(F.array_repeat(F.lit(""), k), "_t"), 1, F.size("_t")).alias(f"_{k}") for k in range(order - 1, 0, -1)]
    each = tokens.select(*tokens.columns[:-1], F.posexplode(F.arrays_zip(*before, F.col("_t"))).alias("i", "_w"))
    h = F.concat_ws(" ", *[F.col(f"_w._{k}") for k in range(order - 1, 0, -1)]) if order > 1 else F.lit("")
    return each.select(*tokens.columns[:-1], "i", h.alias("h"), F.col("_w._t").alias("w"))


def _last(h: Column, n: int) -> Column:
    return F.substring_index(h, " ", -n) if n else F.lit("")


def _discounts(n: Row) -> list[float]:
    """What is taken from counts of 1, of 2, and of 3 or more, from how many grams have counts of 1 to 4."""
    if not n["n1"] or not n["n2"]:
        return [_UNKNOWN * k for k in (1, 2, 3)]
    y = n["n1"] / (n["n1"] + 2 * n["n2"])
    found = [k - (k + 1) * y * n[f"n{k + 1}"] / n[f"n{k}"] if n[f"n{k}"] else _UNKNOWN * k for k in (1, 2, 3)]
    return [min(max(d, _LEAST * k), _MOST * k) for k, d in zip((1, 2, 3), found, strict=True)]


def _taken(d: list[float]) -> Column:
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def fit_ngrams(train: DataFrame, order: int = ORDER, code: str = "code") -> NgramModel:
    """Counts over whole texts; of shorter grams, in how many different words they continue (continuation counts)."""
    counts = _windows(train, [], code, order).groupBy("h", "w").agg(F.count("*").alias("c"))
    grams, contexts, discounts, totals, words = [], [], [], [], 0
    for n in range(order, 0, -1):
        counts = stored(counts, f"grams-{n}")
        sizes = [F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5)]
        found = counts.agg(*sizes, F.sum("c").alias("total"), F.count("*").alias("rows")).first()
        d, words = _discounts(found), found["rows"]
        sums = counts.groupBy("h").agg(F.sum("c").alias("n"), F.sum(_taken(d)).alias("_taken"))
        contexts.insert(0, stored(sums.select("h", "n", (F.col("_taken") / F.col("n")).alias("b")), f"contexts-{n}"))
        grams.insert(0, counts)
        discounts.insert(0, d)
        totals.insert(0, found["total"] or 0)
        # each gram is one continuation of the gram without its first word
        counts = counts.groupBy(_last(F.col("h"), max(0, n - 2)).alias("h"), "w").agg(F.count("*").alias("c"))
    return NgramModel(grams, contexts, discounts, totals, 1.0 / (words + 1))


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], frequent: str, total: int) -> DataFrame:
    """``rows`` with the ``values`` of ``table`` by ``keys``, null where there is none; hot keys never meet in a shuffle.

    ``total`` is the sum of ``frequent``, so fewer than ``HOT_PAIRS`` keys have more than that share of it: these are sent to every task, and their
    rows are dealt by keys that no table has, with one more word.
    """
    hot = table.where((F.col(frequent) * HOT_PAIRS > total) & (sum((F.length(k) for k in keys), F.lit(0)) <= _HOT_CHARS))
    hot = hot.select(*keys, F.struct(*values).alias("_hot"))
    met = rows.join(F.broadcast(hot), keys, "left")
    spread = F.concat(F.col(keys[-1]), F.lit(" "), F.pmod(F.xxhash64(*rows.columns), F.lit(_SPREAD)).cast("string"))
    met = met.withColumn("_at", F.when(F.col("_hot").isNotNull(), spread).otherwise(F.col(keys[-1])))
    wanted = table.select(*keys[:-1], F.col(keys[-1]).alias("_at"), F.struct(*values).alias("_far"))
    met = met.join(wanted, [*keys[:-1], "_at"], "left")
    found = F.coalesce("_hot", "_far")
    return met.select(*rows.columns, *[found[v].alias(v) for v in values])


def price_windows(windows: DataFrame, model: NgramModel) -> DataFrame:
    """Append ``p``, the probability of ``w`` after ``h``, to rows with (h, w); c, n and b must not be among their columns.

    Order by order, p = a(h, w) + b(h) * (p of the context without its first word), from one over the number of words and an unknown one. A context
    that was never seen leaves all to the shorter one. Each shorter window is priced once.
    """
    return _priced(windows, model, model.order)


def _priced(rows: DataFrame, model: NgramModel, n: int) -> DataFrame:
    met = _looked_up(rows, model.grams[n - 1], ["h", "w"], ["c"], "c", model.totals[n - 1])
    if n == 1:
        # at most one row
        met = met.join(F.broadcast(model.contexts[0]), "h", "left").withColumn("_shorter", F.lit(model.unseen))
    else:
        met = _looked_up(met, model.contexts[n - 1], ["h"], ["n", "b"], "n", model.totals[n - 1])
        h = _last(F.col("h"), n - 2)
        uses = stored(rows.groupBy(h.alias("h"), "w").agg(F.count("*").alias("_uses")), f"windows-{n - 1}")
        total = uses.agg(F.sum("_uses")).first()[0] or 0
        shorter = stored(_priced(uses, model, n - 1), f"priced-{n - 1}")
        shorter = shorter.select(F.col("h").alias("_h"), "w", F.col("p").alias("_shorter"), "_uses")
        met = _looked_up(met.withColumn("_h", h), shorter, ["_h", "w"], ["_shorter"], "_uses", total)
    a = F.greatest(F.col("c") - _taken(model.taken[n - 1]), F.lit(0.0)) / F.col("n")
    p = F.coalesce(a, F.lit(0.0)) + F.coalesce("b", F.lit(1.0)) * F.col("_shorter")
    return met.select(*rows.columns, p.alias("p"))


def log_likelihood(df: DataFrame, model: NgramModel, keys: tuple[str, ...] = ("id",), code: str = "code") -> DataFrame:
    """(keys, n_predicted, ll): mean log-probability of all tokens of whole texts but the first; null where there is none."""
    named = [F.col(k).alias(f"_key_{k}") for k in keys]
    steps = _windows(df, named, code, model.order).where("i > 0")
    priced = price_windows(steps, model).select(*[f"_key_{k}" for k in keys], F.log("p").alias("logp"))
    # texts of one token or none have a row as well
    blank = df.select(*named, F.lit(None).cast("double").alias("logp"))
    sums = priced.unionByName(blank).groupBy(*[F.col(f"_key_{k}").alias(k) for k in keys])
    sums = sums.agg(F.sum("logp").alias("_sum"), F.count("logp").alias("n_predicted"))
    return sums.select(*keys, "n_predicted", F.round(F.try_divide("_sum", "n_predicted"), _SCORE_DIGITS).alias("ll"))
