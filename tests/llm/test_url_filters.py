"""URL rules against a plain loop over rules."""

import random

import pytest

from nomenroll.llm import url_filters
from nomenroll.llm.queries import URL_RULES

URLS = [None, "", "no scheme", "http://", "https://www.example.com/en/x", "https://example.com/en/", "http://a.example.com/en?x", "http://b.net/es/1#y", "http://b.net/es", "HTTP://B.NET/fr/", "ftp://com", "x://com/", "http://xcom/", "http://.com/", "http://www.example.com:80/en/", "http://a.b/c://d.com/"]


def judged(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url[url.index("://") + 3 :]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), a == "block", h + p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, default)


def check(spark, urls, rules, **options):
    table = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, other string")
    frame = spark.createDataFrame(rules, url_filters.RULES_SCHEMA)
    result = url_filters.judge(table, frame, **options)
    assert result.columns == ["page_id", "url", "other", "host", "path", "rule", "verdict"]
    rows = result.collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url, [(h, p or "", a) for h, p, a in rules], options.get("default", "allow")), r
    return result


def test_given_rules(spark):
    result = check(spark, URLS + URLS[4:8], URL_RULES)
    plan = result._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert not any(x in plan for x in ("EvalPython", "InArrow", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


@pytest.mark.parametrize("shard_keys", [1000, 12])
def test_many_rules(spark, shard_keys):
    rng = random.Random(5)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    path = lambda: "/" + "/".join(rng.choice("xy") for _ in range(rng.randint(0, 2)))
    rules = {(host(), path()): rng.choice(["allow", "block"]) for _ in range(30)}
    urls = [f"http://{host()}{path()}" for _ in range(400)]
    check(spark, urls, [(h, p, a) for (h, p), a in rules.items()], shard_keys=shard_keys)


def test_empty_and_odd_rules(spark):
    check(spark, URLS, [], default="block")
    check(spark, URLS, [("com", None, "block"), ("com", None, "block"), (None, "/", "block"), ("", "/", "block"), ("net", "/", "allow"), ("net", "/", "block")][:4])
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge(empty, spark.createDataFrame(URL_RULES, url_filters.RULES_SCHEMA)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).selectExpr("cast(id as string) key")
    listed = universe.filter("cast(key as int) % 17 = 0")
    cascade = url_filters.Cascade(listed, universe, seed=3)
    wrong = cascade.onto(universe).filter(cascade.listed(universe["key"]) != (universe["key"].cast("int") % 17 == 0))
    assert wrong.count() == 0 and len(cascade.levels) > 1
