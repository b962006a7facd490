import random

import pytest
from pyspark.sql import functions as F

from offerlake.llm import url_cascade as U


def brute(urls, rules, default="allow"):
    out = {}
    for i, url in urls:
        at = url.find("://") if url is not None else -1
        rest = url[at + 3:] if at >= 0 else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        best = None
        for h, p, action in rules:
            p = p or ""
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(h + p), len(h)) > (len(best[0]), best[2]) or (h + p == best[0] and action == "block")):
                best = (h + p, action, len(h))
        out[i] = (host, path, best[0] if best else None, best[1] if best else default)
    return out


URLS = [(0, "http://Sub.Example.ORG/es/x?y#z"), (1, "https://example.org/en/12"), (2, "http://example.org"), (3, None), (4, "no scheme"), (5, "http://badexample.org/es/"), (6, "http://x.com/fr/1"),
        (7, "http://x.com/de/#a"), (8, "http://x.net/"), (9, "http:///path"), (10, "http://u:p@example.org:80/es/"), (11, "http://a.b.c.d.example.org/es/" + "q" * 50000), (12, ""), (1, "https://example.org/en/12"),
        (13, "x://y://z/p"), (14, "http://" + "a." * 3000 + "org/")]


def test_every_url_gets_the_longest_rule(spark):
    urls = spark.createDataFrame(URLS, "page_id bigint, url string").withColumn("rule", F.lit("mine")).withColumn("labels", F.lit(1))
    rules = spark.createDataFrame(U.RULES, "host string, path string, action string")
    want = brute(URLS, U.RULES)
    for limit in (64 << 20, 0):     # by filters, and by the join that stands in for too large a filter
        got = U.judge_urls(urls, rules, max_filter_bytes=limit).collect()
        assert len(got) == len(URLS)
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want


def test_a_long_list_is_exact(spark):
    rnd = random.Random(5)
    host = lambda: ".".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 3))) + rnd.choice([".com", ".org"])
    urls = [(i, f"http://{host()}/{rnd.choice('xyz')}/{i % 7}") for i in range(4000)]
    rules = list({(h, p): (h, p, rnd.choice(["allow", "block"])) for h, p in ((host(), rnd.choice([None, "/", "/x", "/y/1"])) for _ in range(300))}.values())
    rules += [(h, p, "block") for h, p, _ in rules[:20]]
    got = U.judge_urls(spark.createDataFrame(urls, "page_id bigint, url string"), spark.createDataFrame(rules, "host string, path string, action string")).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == brute(urls, rules)


@pytest.mark.parametrize("rules", [[], [("org", "/", "block")]])
def test_empty_tables(spark, rules):
    listed = spark.createDataFrame(rules, "host string, path string, action string")
    assert U.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), listed).collect() == []
    got = U.judge_urls(spark.createDataFrame([(1, "http://a.org/x")], "page_id bigint, url string"), listed).first()
    assert got.verdict == ("block" if rules else "allow")
