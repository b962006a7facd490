"""Schedules on a calendar and joins by distance against brute force."""

import math
import random
from datetime import date

from pyspark.sql import functions as F

from offerlake.operators import calendar as cal
from offerlake.operators import geojoins as geo

SCHEDULE = "offer int, days array<int>, monthly string, windows array<struct<a:int,b:int>>, zone string, since date, until date"


def dates(spark, start, end, days=(), monthly="", windows=()):
    df = spark.createDataFrame([(1, list(days), monthly, list(windows), "", None, None)], SCHEDULE)
    at = lambda x: F.lit(x).cast("timestamp")                                                       # noqa: E731
    return sorted(r["day"] for r in cal.tm_occurrences(df, at(start), at(end), F.lit("America/Chicago")).collect())


def test_both_mondays(spark):
    assert dates(spark, "2026-10-05 15:00:00", "2026-10-12 15:00:00", [0]) == [date(2026, 10, 5), date(2026, 10, 12)]


def test_hours_over_or_not_begun(spark):
    wed = ("2026-10-07 22:00:00", "2026-10-14 22:00:00")                                            # 5 pm in Chicago
    assert dates(spark, *wed, [2], windows=[(None, 16 * 3600)]) == [date(2026, 10, 14)]
    assert dates(spark, *wed, [2], windows=[(17 * 3600, None)]) == [date(2026, 10, 7)]


def test_monthly_rules(spark):
    month = ("2026-10-01 12:00:00", "2026-10-31 12:00:00")
    assert dates(spark, *month, monthly="1:1") == [date(2026, 10, 6)]
    assert dates(spark, *month, monthly="-1:4") == [date(2026, 10, 30)]
    assert dates(spark, *month, monthly="d:7") == [date(2026, 10, 7)]


def test_wording(spark):
    said = {"Mondays through Fridays": [0, 1, 2, 3, 4], "every day but Saturday": [0, 1, 2, 3, 4, 6], "Tuesdays and Thursdays": [1, 3], "Ruby Tuesday pies daily": [0, 1, 2, 3, 4, 5, 6]}
    df = spark.createDataFrame([(k,) for k in said], "t string")
    assert {r["t"]: list(r["d"]) for r in df.select("t", cal.weekdays_in(F.col("t")).alias("d")).collect()} == said


def miles(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 3958.8 * 2 * math.asin(min(1.0, math.sqrt(h)))


def scattered(n, seed, lat=(-80, 80), lon=(-180, 180)):
    r = random.Random(seed)
    # some in a crowd, some at the date line, some far north
    return [(i, *((r.uniform(30, 30.5), r.uniform(-97.5, -97)) if i % 3 == 0 else (r.uniform(-5, 5), r.choice((-1, 1)) * r.uniform(179.5, 180)) if i % 3 == 1 else (r.uniform(70, 71), r.uniform(20, 22)))) for i in range(n)]


def test_nearest_place_is_brute_force(spark):
    a, p = scattered(60, 1), scattered(90, 2)
    areas = spark.createDataFrame(a, "id int, lat double, lon double")
    places = spark.createDataFrame([(i % 4, lat, lon, f"p{i:03d}") for i, lat, lon in p], "chain int, lat double, lon double, ref string")
    got = {(r["area"], r["chain"]): r["ref"] for r in geo.jn_nearest_place(areas, places, 50.0, 5.0).collect()}
    want = {}
    for i, lat, lon in a:
        for ch in range(4):
            near = min((miles((lat, lon), (y, x)), f"p{j:03d}") for j, y, x in p if j % 4 == ch)
            if math.floor(near[0] * 10 + 0.5) / 10 <= 50:
                want[i, ch] = near[1]
    assert got == want and len(want) > 50


def test_anchors_are_the_greedy_ones(spark):
    r = random.Random(3)
    a = [(i, lat, lon, r.randrange(1000)) for i, lat, lon in scattered(120, 4)]
    got = {x["id"] for x in geo.cov_anchors(spark.createDataFrame(a, "id int, lat double, lon double, population int"), 15.0, 950).collect()}
    order = sorted(a, key=lambda x: (-x[3], x[0]))
    want = [x for x in order if x[3] >= 950]
    for x in order:
        if x[3] < 950 and all(miles(x[1:3], y[1:3]) > 15 for y in want):
            want.append(x)
    assert got == {x[0] for x in want}


def test_nearest_anchor_among_a_crowd(spark):
    rnd = random.Random(9)
    areas = [(i, 30 + rnd.random() * 6, -100 + rnd.random() * 6) for i in range(120)]
    anchors = [(1000 + i, 30.5 + rnd.random() * 0.02, -99.5 + rnd.random() * 0.02) for i in range(400)] + [(2000, 35.9, -94.2), (2001, 35.9, -94.2)]
    schema = "id int, lat double, lon double"
    at = lambda r: tuple(math.radians(x) for x in r[1:])                                            # noqa: E731
    mi = lambda a, b: 2 * 3958.8 * math.asin(min(1.0, math.sqrt(math.sin((b[0] - a[0]) / 2) ** 2 + math.cos(a[0]) * math.cos(b[0]) * math.sin((b[1] - a[1]) / 2) ** 2)))
    found = geo.jn_city_anchor(spark.createDataFrame(areas, schema), spark.createDataFrame(anchors, schema), 60.0)
    want = {a[0]: min((mi(at(a), at(b)), b[0]) for b in anchors) for a in areas}
    got = {r["id"]: (r["anchor"], r["anchor_mi"]) for r in found.collect()}
    assert len(got) == len(areas) and all(got[i][0] == b and abs(got[i][1] - d) <= 0.051 for i, (d, b) in want.items())


def test_a_crowd_of_anchors_is_not_met_whole(spark):
    """Cells are shrunk until they hold few anchors: one cell of the given size holds all of these."""
    tried = []

    class Noted(geo.Grid):
        def __init__(self, mi):
            tried.append(mi)
            super().__init__(mi)
    schema, own = "id int, lat double, lon double", geo.Grid
    geo.Grid = Noted
    try:
        points = spark.createDataFrame([(i, 30.0 + i * 0.001, -100.0) for i in range(400)], schema)
        assert geo.jn_city_anchor(points, points, 60.0).where("anchor = id AND anchor_mi = 0").count() == 400
    finally:
        geo.Grid = own
    assert min(tried) < 2
