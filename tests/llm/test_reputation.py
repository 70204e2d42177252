"""URL filter: addresses, rules and shrunk reputations against plain Python."""

import math
import random
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from inkprint.llm import reputation as R

PAGE = "page_id long, url string, host string, _rule string"
OUTCOME = "url string, bad boolean"


def parts_of(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host = R.url_host(F.col("url"))
    rows = df.select("url", host.alias("host"), R.url_path(F.col("url")).alias("path"), *[c.alias(k) for k, c in R.site_parts(host).items()])
    return {r.url: (r.host, r.path, r.domain, r.suffix) for r in rows.collect()}


def test_addresses(spark):
    expected = {
        "http://A.B.example.COM/x/Y?q=/z#f": ("a.b.example.com", "/x/Y", "example.com", "com"),
        "//host/path": ("", "", None, None),
        "https://shop.co.uk": ("shop.co.uk", "", "shop.co.uk", "co.uk"),
        "https://www.shop.co.uk?x": ("www.shop.co.uk", "", "shop.co.uk", "co.uk"),
        "x://u:p@h.de:80./": ("u:p@h.de:80.", "/", "h.de", "de"),
        "http://localhost/": ("localhost", "/", "localhost", "localhost"),
        "http://10.0.0.1:8/": ("10.0.0.1:8", "/", "10.0.0.1", "address"),
        "see http://a.org/1://b": ("a.org", "/1://b", "a.org", "org"),
        "http://": ("", "", None, None),
        "http://É.fr/Ü\n/a#": ("É.fr", "/Ü\n/a", "É.fr", "fr"),
        None: ("", "", None, None),
        "": ("", "", None, None),
    }
    assert parts_of(spark, list(expected)) == expected


def test_longest_rule_wins_and_ties_block(spark):
    rules = [
        R.Rule("block", "net"), R.Rule("allow", "example.net", "/en/"), R.Rule("allow", "a.org", "/xyz"), R.Rule("block", "b.a.org", "/x"),
        R.Rule("allow", "same.de"), R.Rule("block", "same.de"),
    ]
    urls = ["http://x.example.net/en/1", "http://example.net/en", "http://net/", "http://net", "http://ample.netx/", "http://notexample.net/en/",
            "http://b.a.org/xyz", "http://c.a.org/xyz", "http://same.de/", None]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], PAGE)
    found = {r.page_id: (r.rule, r.verdict) for r in R.judge_urls(pages, spark.createDataFrame([], OUTCOME), rules).collect()}
    assert found == {
        0: ("example.net/en/", "allow"), 1: ("net/", "block"), 2: ("net/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: ("net/", "block"),
        6: ("b.a.org/x", "block"), 7: ("a.org/xyz", "allow"), 8: ("same.de/", "block"), 9: (None, "allow"),
    }


def brute(outcomes):
    """Posterior counts of every host, level by level."""
    def key(host):
        labels = host.split(".")
        return ".".join(labels[-2:]), labels[-1]

    def counts(name):
        found = {}
        for url, bad in outcomes:
            if bad is not None and url:
                n, k = found.get(name(urlsplit(url).netloc), (0, 0))
                found[name(urlsplit(url).netloc)] = (n + 1, k + bad)
        return found

    def shrink(level, centre_of):
        spread = pairs = 0.0
        for name, (n, k) in level.items():
            c = centre_of(name)
            spread += (k - n * c) ** 2 - n * c * (1 - c)
            pairs += n * (n - 1) * c * (1 - c)
        rho = round(spread / pairs, 9) if pairs else 0
        w = max(1.0, min(1 / rho - 1, 10_000.0)) if rho > 0 else 10_000.0
        return {name: (k + w * centre_of(name), n - k + w * (1 - centre_of(name))) for name, (n, k) in level.items()}

    n, k = counts(lambda h: 0).get(0, (0, 0))
    mean = lambda ab: ab[0] / sum(ab)
    suffixes = shrink(counts(lambda h: key(h)[1]), lambda _: (k + 0.5) / (n + 1))
    domains = shrink(counts(lambda h: key(h)[0]), lambda d: mean(suffixes[d.split(".")[-1]]))
    return shrink(counts(lambda h: h), lambda h: mean(domains[key(h)[0]]))


@pytest.fixture(scope="module")
def outcomes():
    rng = random.Random(5)
    shares = {f"h{i}.d{i % 4}.{('com', 'org')[i % 2]}": rng.choice([0.02, 0.1, 0.9]) for i in range(24)}
    rows = [(f"http://{h}/{j}", rng.random() < p) for h, p in shares.items() for j in range(rng.randrange(1, 60))]
    return rows + [("http://hot.d0.com/", False)] * 900 + [(None, True), ("http://h1.d1.org/", None)]


@pytest.mark.parametrize("groups", [10_000, 3])
def test_posteriors_match_brute_force(spark, outcomes, groups, monkeypatch):
    monkeypatch.setattr("inkprint.storage.MAX_BROADCAST_GROUPS", groups)
    known = spark.createDataFrame(outcomes, OUTCOME)
    expected = brute(outcomes)
    pages = spark.createDataFrame([(i, f"http://{h}/p", "x", "y") for i, h in enumerate(expected)], PAGE)
    found = {r.host: r for r in R.judge_urls(pages, known, max_bad=0.3).collect()}
    assert set(found) == set(expected)
    for host, (a, b) in expected.items():
        mean = a / (a + b)
        bound = max(0.0, mean - 1.645 * math.sqrt(mean * (1 - mean) / (a + b + 1)))
        assert (found[host].bad_share, found[host].bad_bound) == pytest.approx((mean, bound), abs=2e-6)
        assert found[host].verdict == ("block" if bound > 0.3 else "allow")
    assert {"block", "allow"} == {r.verdict for r in found.values()}


def test_strangers_take_the_nearest_level_and_edges_are_defined(spark, outcomes):
    known = spark.createDataFrame(outcomes, OUTCOME)
    pages = spark.createDataFrame(
        [(1, "http://new.d0.com/", "a", "b"), (1, "http://new.d0.com/", "a", "b"), (None, "http://x.new.com/", "a", "b"),
         (3, "http://z.zz/", "a", "b"), (4, None, "a", "b"), (5, "http://" + "a" * 100_000 + ".com/" + "b" * 100_000, "a", "b")], PAGE)
    rows = R.judge_urls(pages, known).collect()
    assert len(rows) == 6 and sum(r.page_id == 1 for r in rows) == 2
    of = {r.page_id: r for r in rows}
    levels = {k: v.collect() for k, v in R.host_reputation(known.select(R.url_host(F.col("url")).alias("host"), "bad")).items()}
    domain = next(r for r in levels["domain"] if r.domain == "d0.com")
    suffix = next(r for r in levels["suffix"] if r.suffix == "com")
    everything = levels["all"][0]
    for page, level in ((1, domain), (None, suffix), (3, everything)):
        assert of[page].bad_share == pytest.approx(level.a / (level.a + level.b), abs=1e-6) and of[page].n_outcomes == 0
    assert (of[4].host, of[4].path, of[4].verdict, of[4].bad_share) == ("", "", "allow", None)
    empty = spark.createDataFrame([], OUTCOME)
    assert {r.bad_share for r in R.judge_urls(pages, empty).collect()} == {0.5, None}
    assert R.judge_urls(spark.createDataFrame([], PAGE), known).count() == 0
