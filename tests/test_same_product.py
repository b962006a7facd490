"""Same products by lots, and venues, against brute force over all pairs."""

import random
from itertools import product

from offerlake.operators import identity as idn
from offerlake.operators import textjoins as tj

SCHEMA = "id int, gtin string, models array<string>, brand string, kinds string, accessory boolean, bundle boolean, condition string, screen string, storage string, oz string, pack string"


def same(a, b):
    (ga, ma, *ra), (gb, mb, *rb) = a[1:], b[1:]
    if ga and gb:
        return ga.lstrip("0") == gb.lstrip("0")
    likes = lambda x, y: x is None or y is None or x == y
    return (bool(set(ma) & set(mb)) and (not ra[0] or not rb[0] or ra[0].lower() == rb[0].lower()) and ra[1:5] == rb[1:5] and all(likes(x, y) for x, y in zip(ra[5:], rb[5:])))


def rows(rnd, n):
    pick = rnd.choice
    return [(i, pick(["", "", "7", "007", "8"]), rnd.sample(["M1", "M2", "M3"], rnd.randrange(3)), pick(["", "Acme", "ACME", "Other"]), "", rnd.random() < .2, False, pick(["new", "new", "open-box"]), pick([None, "20", "30"]), None, None,
             pick([None, "2"])) for i in range(n)]


def test_lots_are_all_pairs_once(spark):
    rnd = random.Random(3)
    a, b = rows(rnd, 150), rows(rnd, 150)
    da, db = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    asks, lots = idn.jn_same_product(da, db)
    x = idn.with_sig(da).select("id", "sig").join(asks, idn.F.col("sig") == idn.F.col("deal_sig")).select(idn.F.col("id").alias("a"), "lot")
    y = idn.with_sig(db).select("id", "sig").join(lots, idn.F.col("sig") == idn.F.col("listing_sig")).select(idn.F.col("id").alias("b"), "lot")
    got = [tuple(r) for r in x.join(y, "lot").select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == {(p[0], q[0]) for p, q in product(a, b) if same(p, q)}


def test_equal_gtins_make_no_pairs(spark):
    many = lambda brand: spark.createDataFrame([(i, "7", [f"{brand}{i}"], brand, "", False, False, "new", None, None, None, None) for i in range(300)], SCHEMA)
    asks, lots = idn.jn_same_product(many("A"), many("B"))
    assert asks.count() == 300 and lots.where("lot LIKE 'gtin%'").count() == 300


def test_venues_by_beginnings_are_not_sent_to_all(spark):
    pois = spark.createDataFrame([(1, "Café Mölln West", None, "bar"), (2, "Ca", "", "bar"), (3, None, "ACME", "pub"), (4, "Cafe", None, "pub"), (None, "Cafe", "", "bar")], "ref int, name string, brand string, type string")
    rules = spark.createDataFrame([(1, "long", ["Cafe Molln"], [], ["bar"]), (2, "short", ["Caf"], [], []), (3, "brand", [], ["Acme"], [])], "ord int, venue string, names array<string>, brands array<string>, types array<string>")
    got = tj.jn_venue_rules(pois, rules)
    assert {(r["ref"], r["venue"]) for r in got.collect()} == {(1, "long"), (2, None), (3, "brand"), (4, "short"), (None, None)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "strategy=merge" in plan
