"""Jobs whose work is pairs: brute force, and work dealt out in a stated number of parts."""

import math
import random

from pyspark.sql import functions as F

from offerlake.operators import aggregates as A
from offerlake.plans import QUERIES
from offerlake.session import stated_parts


def miles(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 3958.8 * math.asin(min(1.0, math.sqrt(h)))


def test_overlap_by_distance_beside_all_pairs(spark, monkeypatch):
    rnd = random.Random(4)
    places = [(30 + rnd.random(), -95 + rnd.random()) for _ in range(12)]
    areas = {i: rnd.choice(places) for i in range(60)}
    ads = {i: set(rnd.sample(range(100, 260), rnd.randint(1, 6))) for i in areas}
    ads.update({i: {100, 101} for i in range(10)})
    want = {}
    for i in areas:
        for j in areas:
            if i < j and miles(areas[i], areas[j]) < 40:
                want.setdefault(int(miles(areas[i], areas[j]) // 10), []).append(len(ads[i] & ads[j]) / len(ads[i] | ads[j]))
    want = {b: (len(s), math.floor(sum(s) / len(s) * 10000 + 0.5) / 10000) for b, s in want.items()}
    at = spark.createDataFrame([(i, a) for i, s in ads.items() for a in s], "area int, ad int")
    where = spark.createDataFrame([(i, *p) for i, p in areas.items()], "id int, lat double, lon double")
    read = lambda: {r.bin: (r.pairs, r.share) for r in A.agg_ad_overlap_by_distance(at, where).collect()}      # noqa: E731
    assert read() == want
    monkeypatch.setattr(A, "CROWD", 3)                   # a crowded cell in several places
    assert read() == want
    monkeypatch.setattr(A, "MOST_BITS", 64)              # more ads than bits: lists
    assert read() == want


def test_pairs_are_dealt_out(spark):
    for name in ("agg_ad_overlap_by_distance", "fn_haversine"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        df.collect()
        assert f", {stated_parts(spark)}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString(), name


def test_given_cosines_change_no_distance(spark):
    from offerlake.functions import fn_haversine
    from offerlake.functions.geo import cos_lat
    df = spark.createDataFrame([(30.0, -95.0, 31.5, -96.0), (0.0, 0.0, 0.0, 180.0), (89.9, 10.0, -89.9, 20.0), (None, 1.0, 2.0, 3.0)], "a double, b double, x double, y double")
    c = [F.col(n) for n in "abxy"]
    assert all(r[0] == r[1] for r in df.select(fn_haversine(*c), fn_haversine(*c, cos_lat(c[0]), cos_lat(c[2]))).collect())


def test_titles_of_not_sales_are_read_in_dealt_tasks(spark):
    plan = QUERIES["flt_not_sale"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [id" in plan
