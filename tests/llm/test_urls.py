import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from vitrine.llm import urls
from vitrine.llm.queries import URL_RULES


def parsed(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


PAGES = [None, "", "no scheme", "://", "http://", "https://Example.ORG/es/x?y#z", "ftp://a.example.org/en/1", "http://example.org", "http://x.org?q=/es/", "http://com/fr/1", "http://xcom/fr/1", "http://a.com/de/", "http://a.com/DE/", "http://ÄB.com/fr/#a://b", "x://y://org/", "http://org/\n/a", "http://a.b.net:80/p", "http://u@a.b.net/p", "http://1.2.3.4/x", "http://example.org/en/12"]


def test_rules_are_literal(spark):
    rows = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(PAGES)], "page_id long, url string, host string, verdict string")
    found = {r["page_id"]: r for r in urls.url_filter(rows, URL_RULES).collect()}
    assert len(found) == len(PAGES)
    for i, u in enumerate(PAGES):
        host, path = parsed(u)
        text, verdict = rule(host, path)
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, text), u
        assert r["verdict"] == verdict or verdict is None and r["verdict"] in ("allow", "block")


def test_reputation_shrinks(spark):
    rng = random.Random(0)
    rows = [(f"h{i}.good.net", rng.random() < 0.02) for i in range(8) for _ in range(60)] + [(f"h{i}.bad.net", rng.random() < 0.97) for i in range(8) for _ in range(60)]
    rows += [("new.bad.net", None), ("new.good.net", None), ("one.other.net", True), ("", None)]
    found = {r["host"]: r for r in urls.host_reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert all(found[f"h{i}.bad.net"]["blocked"] and not found[f"h{i}.good.net"]["blocked"] for i in range(8))
    # hosts without outcomes take after their domain; one bad page isn't enough
    assert found["new.bad.net"]["bad_mean"] > 0.8 > 0.3 > found["new.good.net"]["bad_mean"]
    assert not found["one.other.net"]["blocked"] and not found[""]["blocked"]
    assert found["h0.bad.net"]["pages"] == 60 == found["h0.bad.net"]["labelled"]


def test_frequent_hosts_and_empty_tables(spark):
    rows = spark.range(4000).selectExpr("id AS page_id", "concat('http://', if(id % 3 = 0, 'hot.net', concat('h', id, '.net')), '/a') AS url", "id AS n")
    out = urls.url_filter(rows.unionByName(rows), URL_RULES)
    assert out.count() == 8000 and out.filter("verdict = 'block'").count() == 0
    assert urls.url_filter(rows.limit(0), URL_RULES).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_the_method_blocks_and_allows(spark):
    """Pages that no rule fits: blocked on a host whose ruled pages are nearly all blocked, allowed elsewhere; an id may be null, a url very long."""
    rows = [(i, f"http://bad{i % 5}.com/de/{i}") for i in range(300)] + [(1000 + i, f"http://good{i % 5}.com/fr/{i}") for i in range(300)]
    rows += [(2000, "http://bad1.com/it/1"), (None, "http://bad2.com/"), (2002, "http://good1.com/it/1"), (2003, "http://other.net/"), (2004, "http://bad3.com/" + "x" * 3_000_000)]
    found = {r["page_id"]: r for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES, urls.SUFFIXES).collect()}
    assert [found[k]["verdict"] for k in (2000, None, 2002, 2003, 2004)] == ["block", "block", "allow", "allow", "block"]
    assert all(found[k]["rule"] is None for k in (2000, None, 2002, 2003, 2004)) and len(found[2004]["path"]) == 3_000_001


def test_the_bound_is_conservative():
    """By draws from the posterior: the share is over the bound at least as often as stated, for few outcomes too."""
    rng = np.random.default_rng(4)
    for a, b in ((0.6, 5.0), (2.0, 1.0), (5.0, 0.4), (40.0, 3.0)):
        mean = a / (a + b)
        bound = mean - math.sqrt(urls.SURE / (1 - urls.SURE)) * math.sqrt(mean * (1 - mean) / (a + b + 1))
        assert (rng.beta(a, b, 100_000) > bound).mean() >= urls.SURE


def test_registered_domains(spark):
    tests = {"a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "x.y.example.com": "example.com", "u@h.net:80": "h.net", "1.2.3.4": "1.2.3.4", "": "", "me.github.io": "me.github.io"}
    rows = spark.createDataFrame([(h,) for h in tests], "host string")
    assert {r[0]: r[1] for r in rows.select("host", urls.registered_domain(F.col("host"), urls.SUFFIXES)).collect()} == tests


def test_prior_strength():
    assert urls.prior_strength(0, 0, 0, 0, 0) == 10.0 and urls.prior_strength(3, 30, 30, 300, 30) == 10.0
    tight = urls.prior_strength(4, 400, 200, 40_000, 100.0)  # all groups alike
    loose = urls.prior_strength(4, 400, 200, 40_000, 199.0)  # each all good or all bad
    assert tight == 1000.0 and loose == 5.0
