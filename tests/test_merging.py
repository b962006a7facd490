"""Merging in rounds against the one-by-one order, rankings, and the stream against a loop."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from offerlake.operators import fuzzy
from offerlake.operators.merging import dd_regular_merge
from offerlake.operators.orders import srt_pick_nine
from offerlake.operators.windows import win_quota_replace
from offerlake.session import work_path
from offerlake.streaming.streams import stm_read_log


def greedy(order, like):
    kept, lead = [], {}
    for x in order:
        first = next((k for k in kept if like(k, x)), None)
        lead[x] = first if first is not None else x
        if first is None:
            kept.append(x)
    return lead


def test_leaders_are_the_greedy_ones(spark):
    r = random.Random(5)
    n = 40
    pairs = {(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.06}
    cliques = [(r.randrange(n), f"k{r.randrange(25)}") for _ in range(50)]
    keys = {}
    for x, k in cliques:
        keys.setdefault(x, set()).add(k)
    rank = list(range(n))
    r.shuffle(rank)
    want = greedy(sorted(range(n), key=lambda x: rank[x]), lambda a, b: (min(a, b), max(a, b)) in pairs or bool(keys.get(a, set()) & keys.get(b, set())))
    nodes = spark.createDataFrame([(i, rank[i]) for i in range(n)], "node int, rank int")
    got = fuzzy.first_leaders(nodes, spark.createDataFrame(sorted(pairs), "a int, b int"), spark.createDataFrame(cliques, "node int, key string"))
    assert {x["node"]: x["lead"] for x in got.collect()} == want


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    n, rounds = 1000, []
    monkeypatch.setattr(fuzzy, "chain_leaders", lambda *a, f=fuzzy.chain_leaders: rounds.append(1) or f(*a))
    nodes = spark.range(n).selectExpr("id AS node", "id AS rank")
    got = {x["node"]: x["lead"] for x in fuzzy.first_leaders(nodes, spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")).collect()}
    assert got == {i: i - i % 2 for i in range(n)} and len(rounds) <= 2
    keyed = spark.range(n).selectExpr("id AS node", "explode(array(concat('k', id), concat('k', id + 1))) AS key")          # the same path by shared keys
    got = {x["node"]: x["lead"] for x in fuzzy.first_leaders(nodes, None, keyed).collect()}
    assert got == {i: i - i % 2 for i in range(n)} and len(rounds) <= 4


def test_similar_pairs_are_all_pairs(spark):
    r = random.Random(6)
    sets = [(i, "b", sorted({f"w{r.randrange(9)}" for _ in range(r.randrange(1, 6))})) for i in range(40)]
    df = spark.createDataFrame(sets, "node int, block string, words array<string>")
    for measure, share in (("overlap", 0.6), ("jaccard", 0.5)):
        got = {tuple(sorted((x["a"], x["b"]))) for x in fuzzy.similar_pairs(df, "block", share, measure).collect()}
        of = (lambda a, b: min(len(a), len(b))) if measure == "overlap" else (lambda a, b: len(a | b))
        want = {(i, j) for i, _, a in sets for j, _, b in sets if i < j and len(set(a) & set(b)) >= share * of(set(a), set(b)) - 1e-9}
        assert got == want


def test_two_posts_of_one_sale(spark):
    day = datetime(2026, 10, 8)
    rows = [("a", "kohls", "", "20% off", day, "Deal Days Shoe Sale", "", "Hip2Save", day), ("b", "kohls", "", "20% off", day, "Deal Days Shoes", "SAVE", "DealCatcher", day), ("c", "kohls", "", "20% off", day, "Toy Clearance", "", "dealnews", day)]
    df = spark.createDataFrame(rows, "id string, store string, store_name string, badge string, ends_at timestamp, name string, code string, source string, posted_at timestamp")
    got = {x["id"]: (x["lead"], x["lead_code"]) for x in fuzzy.dd_sales(df).collect()}
    # "days" and "shoe" of two against "days" and "shoes": one of two words is shared
    assert got["c"] == ("c", "") and got["a"][0] == "a"


def test_price_clash_and_agreement(spark):
    rows = [("l1", "c", "list", "A", "Acme", "Get a turkey lunch plate for $9.99", [0], 9.99), ("l2", "c", "list", "B", "Acme", "Get a turkey lunch plate for $14.49", [0], 14.49), ("l3", "c", "list", "C", "Acme", "Turkey lunch plate now for $9.99 only", [0], 9.99)]
    df = spark.createDataFrame(rows, "id string, chain string, origin string, source string, brand string, offer string, days array<int>, price double").withColumns(
        {"pct": F.lit(None).cast("double"), "regular": F.lit(None).cast("double"), "bogo": F.lit(""), "summary": F.lit(""), "until": F.lit(None).cast("date"), "url": F.lit("")})
    kept, reasons = dd_regular_merge(df)
    assert [x["price"] for x in kept.collect()] == [9.99]                                            # two sources agree on it
    assert [x["n"] for x in reasons.collect()] == [1]


def test_nine_picked(spark):
    r = random.Random(7)
    rows = [(k, f"b{r.randrange(14)}", f"{k}{i}", float(r.randrange(100)), None, None) for k in ("regular", "promotion", "online", "sale") for i in range(12)]
    df = spark.createDataFrame(rows, "kind string, brand string, id string, rank double, shown_from timestamp, shown_until timestamp")
    got = srt_pick_nine(df, F.lit("2026-10-05").cast("timestamp")).orderBy("place").collect()
    assert len(got) == 9 and len({x["brand"] for x in got}) == 9
    kinds = [x["kind"] for x in got]
    assert all(kinds.count(k) <= 3 for k in set(kinds)) and all(len(set(kinds[i:i + 3])) == 3 for i in (0, 3))


def test_quota(spark):
    rows = [("c", i, v) for i, v in enumerate(["pass", "inconclusive", "fail", "pass", "inconclusive", "pass"])]
    got = win_quota_replace(spark.createDataFrame(rows, "category string, pos int, verdict string"), 3)
    assert sorted(x["pos"] for x in got.collect()) == [0, 1, 2, 3]


def test_read_log_stream(spark):
    r, t0 = random.Random(8), datetime(2026, 1, 1)
    rows = sorted((k, t0 + timedelta(minutes=m), r.random() < 0.6) for k in range(3) for m in r.sample(range(2000), 40))     # reads of one key and time count once
    path = work_path(spark, "reads")
    spark.createDataFrame(rows, "key bigint, checked_at timestamp, found boolean").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("key bigint, checked_at timestamp, found boolean").parquet(path)
    out = work_path(spark, "kept")
    stm_read_log(stream, out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start().awaitTermination()
    want, last = 0, {}
    for k, t, f in rows:
        if k not in last or (t - last[k][0]).total_seconds() >= 3600 or last[k][1] != f:
            last[k] = (t, f)
            want += 1
    assert spark.read.parquet(f"{out}/kept").count() == want
