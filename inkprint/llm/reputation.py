"""URL filter: rules first, then empirical-Bayes reputation of the host.

Labelled pages are outcomes (bad or not). A host's share of bad pages has a beta prior centred on its registered
domain's, a domain's on its suffix's, and a suffix's on that of all labelled pages. How strongly each level holds to its
parent is estimated from the spread of the outcomes themselves (moments of the beta-binomial).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.tables import ascii_lower
from inkprint.storage import join_groups, stored

ALLOW, BLOCK = "allow", "block"
# A host is blocked where its share of bad pages is above this, by the lower bound of its posterior.
MAX_BAD = 0.25
# The bound lies so many posterior standard deviations below the mean: one-sided 95 % of a normal.
Z = 1.645
# Prior weights that moments may not leave: a pseudo-count of a page, and of ten thousand.
MIN_WEIGHT, MAX_WEIGHT = 1.0, 10_000.0
# Second-level labels under which country domains are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "gob", "go", "mil", "ne", "net", "nom", "or", "org")


@dataclass(frozen=True)
class Rule:
    """Applies to ``host`` and its subdomains, for paths that begin with ``path``."""

    verdict: str
    host: str
    path: str = "/"


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    found = F.instr(url, "://")
    return F.when(found > 0, F.substr(url, found + 3)).otherwise(F.lit(""))


def site_parts(host: Column) -> dict[str, Column]:
    """``domain`` and ``suffix`` of a host: no user, port or final dot; null where there is no name.

    A suffix is the last label, or the last two where a country's label stands behind one of ``SECOND_LEVEL``. A domain has one
    label more. A numeric address is its own domain, under the suffix of all such.
    """
    name = F.regexp_replace(F.regexp_replace(host, r"\A.*@", ""), r"(:[0-9]*)?\.?\z", "")
    second = "|".join(SECOND_LEVEL)
    suffix = F.regexp_extract(name, rf"(?:\A|\.)((?:(?:{second})\.)?[^.]{{2}}|[^.]+)\z", 1)
    domain = F.regexp_extract(name, rf"([^.]+\.(?:(?:(?:{second})\.)[^.]{{2}}|[^.]+))\z", 1)
    numeric = F.rlike(name, F.lit(r"\A([0-9.]+|\[.*\])\z"))
    return {
        "domain": F.when(name == "", None).when(numeric | (domain == ""), name).otherwise(domain),
        "suffix": F.when(name == "", None).when(numeric, "address").otherwise(suffix),
    }


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null without one; of equal length, block wins, then the longer host."""
    fitting = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path)),
            F.struct(
                F.lit(len(r.host + r.path)).alias("length"),
                F.lit(r.verdict == BLOCK).alias("blocks"),
                F.lit(len(r.host)).alias("host_length"),
                F.lit(r.host + r.path).alias("rule"),
                F.lit(r.verdict).alias("verdict"),
            ),
        )
        for r in rules
    ]
    if not fitting:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    best = F.array_max(F.array(*fitting))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _weight(n: Column, bad: Column, centre: Column) -> Column:
    """Pseudo-counts of the prior, by moments: with weight s, Var(bad) = n c (1 - c) (1 + (n - 1) / (s + 1))."""
    spread = F.sum((bad - n * centre) * (bad - n * centre) - n * centre * (1 - centre))
    pairs = F.sum(n * (n - 1) * centre * (1 - centre))
    rho = F.round(F.try_divide(spread, pairs), 9)
    weight = F.when(rho > 0, F.least(1 / rho - 1, F.lit(MAX_WEIGHT))).otherwise(MAX_WEIGHT)
    return F.greatest(weight, F.lit(MIN_WEIGHT))


def _shrunk(level: DataFrame, parents: DataFrame, by: list[str]) -> DataFrame:
    """``level`` (its keys, n, bad) with the posterior counts a and b, shrunk towards ``parents`` (by, centre)."""
    joined = stored(join_groups(level, parents, by), "reputation")
    weight = joined.agg(_weight(F.col("n"), F.col("bad"), F.col("centre")).alias("weight"))
    a = F.col("bad") + F.col("weight") * F.col("centre")
    b = F.col("n") - F.col("bad") + F.col("weight") * (1 - F.col("centre"))
    return joined.crossJoin(F.broadcast(weight)).withColumns({"a": a, "b": b})  # one row


def host_reputation(outcomes: DataFrame) -> dict[str, DataFrame]:
    """Posterior (a, b) of the share of bad pages per ``host``, ``domain``, ``suffix`` and over ``all`` from (host, bad).

    ``bad`` is boolean; null outcomes and empty hosts say nothing. Outcomes are counted per host before anything else, so a host with a
    third of all pages is one row. Each table has n, bad, a and b; ``all`` has one row, Beta(bad + 1/2, n - bad + 1/2).
    The prior's weight of a level is held between ``MIN_WEIGHT`` and ``MAX_WEIGHT``; the latter applies where outcomes
    spread no more than chance would. Every labelled page counts, repeated ones too.
    """
    known = outcomes.where(F.col("bad").isNotNull() & (F.col("host") != ""))
    counted = known.groupBy("host").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    sites = stored(counted.withColumns(site_parts(F.col("host"))).where("domain IS NOT NULL"), "host-outcomes")
    total = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    everything = sites.agg(*[F.coalesce(c, F.lit(0)).alias(name) for c, name in zip(total, ("n", "bad"), strict=True)])
    everything = everything.withColumns({"a": F.col("bad") + 0.5, "b": F.col("n") - F.col("bad") + 0.5})

    def centre(df: DataFrame, by: list[str]) -> DataFrame:
        return df.select(*by, (F.col("a") / (F.col("a") + F.col("b"))).alias("centre"))

    suffixes = _shrunk(sites.groupBy("suffix").agg(*total), centre(everything, []), [])
    domains = _shrunk(sites.groupBy("domain", "suffix").agg(*total), centre(suffixes, ["suffix"]), ["suffix"])
    hosts = _shrunk(sites, centre(domains, ["domain", "suffix"]), ["domain", "suffix"])
    return {"host": hosts, "domain": domains, "suffix": suffixes, "all": everything}


def lower_bound(a: Column, b: Column, z: float = Z) -> Column:
    """``z`` standard deviations below the mean of Beta(a, b), at least 0."""
    mean, total = a / (a + b), a + b
    return F.round(F.greatest(mean - z * F.sqrt(mean * (1 - mean) / (total + 1)), F.lit(0.0)), 9)


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule] = (),
    max_bad: float = MAX_BAD,
    z: float = Z,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_outcomes, bad_share, bad_bound) for every row of (page_id, url).

    The longest rule that fits decides (see ``longest_rule``). Without one a page is blocked if the lower bound of its host's share
    of bad pages is above ``max_bad``. A host without outcomes has the mean of the nearest level with
    outcomes, under the weight that hosts give to their priors, and no more than that level's own pseudo-counts. ``outcomes`` is (url, bad). A null url, or one without ``://``, has an
    empty host and path, fits no rule and is allowed, with null reputation. Repeated rows and null ids are judged row by row, nothing
    but these columns is returned, and an empty table gives no rows.
    """
    levels = host_reputation(outcomes.select(url_host(F.col("url")).alias("host"), "bad"))
    weight_of_hosts = levels["host"].agg(F.coalesce(F.max("weight"), F.lit(MAX_WEIGHT)).alias("_w_host"))
    url = F.col("url")
    judged = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    judged = judged.withColumns({f"_{k}": v for k, v in site_parts(F.col("host")).items()})
    judged = judged.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    for name, keys in (("host", ["host"]), ("domain", ["domain", "suffix"]), ("suffix", ["suffix"])):
        found = levels[name].select(
            *[F.col(k).alias(k if k == "host" else f"_{k}") for k in keys], F.struct("n", "a", "b").alias(f"_of_{name}")
        )
        judged = join_groups(judged, found, [k if k == "host" else f"_{k}" for k in keys])
    # one row each
    judged = judged.crossJoin(F.broadcast(levels["all"].select(F.struct("n", "a", "b").alias("_of_all"))))
    judged = judged.crossJoin(F.broadcast(weight_of_hosts))

    nearest = F.coalesce("_of_domain", "_of_suffix", "_of_all")
    centre = nearest["a"] / (nearest["a"] + nearest["b"])
    weight = F.least(F.col("_w_host"), nearest["a"] + nearest["b"])
    a = F.coalesce(F.col("_of_host.a"), weight * centre)
    b = F.coalesce(F.col("_of_host.b"), weight * (1 - centre))
    named = F.col("_domain").isNotNull()
    bound = F.when(named, lower_bound(a, b, z))
    own = F.when(bound > max_bad, BLOCK).otherwise(ALLOW)
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", own).alias("verdict"),
        F.when(named, F.coalesce("_of_host.n", F.lit(0))).alias("n_outcomes"),
        F.when(named, F.round(a / (a + b), 6)).alias("bad_share"),
        F.round(bound, 6).alias("bad_bound"),
    )
