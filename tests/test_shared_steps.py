"""Steps that several queries share: reading texts before a join, spreading work, comparing sets block by block."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from offerlake.operators import fuzzy, merging, sales
from offerlake.operators import wordwork as ww
from offerlake.operators.standing import job_roundup_offers, standing_conditions
from offerlake.operators.textjoins import jn_dictionary_scan
from offerlake.operators.wordwork import labels_of
from offerlake.plans.inputs import Tables
from offerlake.rules import standing as S
from offerlake.rules import wordings as R


def settled(rows, size):
    """What `settle_classes` says of rows that come in batches of a size."""
    names = ["root", "node", "order", "offer", "id_text", "origin", "source", "words", "named", "price", "pct", "bogo", "summary", "days", "pages", "cue_days", "hours", "suppress", "until", "conditions", "absorbs", "exact_days",
             "monthly", "hours_vary", "cue_conditions", "wording", "n"]
    batches = [pd.DataFrame(rows[i:i + size], columns=names) for i in range(0, len(rows), size)]
    out = [tuple(r)[:2] + tuple(r)[4:] for b in merging.settle_classes(iter(batches)) for r in b.itertuples(index=False)]
    return sorted(map(str, out))


def test_a_class_may_go_on_in_the_next_batch():
    rows = [(root, root * 10 + i, f"21{i}", f"half price {thing}", str(i), "list", f"l{i % 2}", ["half", thing], "", None, 50.0, "", "half price", 1 << i % 2, 127, 0, "", "", None, [], [], False, "", False, [], "", 1)
            for root in range(5) for i, thing in enumerate(["wings", "pies", "wings", "wings"])]
    whole = settled(rows, 100)
    assert len(whole) == 10 and all(settled(rows, size) == whole for size in (1, 3, 7))
    assert list(merging.settle_classes(iter([]))) == []


def test_pairs_of_small_and_large_blocks(spark, monkeypatch):
    rng = random.Random(3)
    sets = [(i, "small" if i < 30 else "large", sorted(rng.sample("abcdefgh", rng.randint(1, 4)))) for i in range(160)] + [(900, None, ["a"]), (901, None, ["a"])]
    df = spark.createDataFrame(sets, "node int, block string, words array<string>")
    for measure, share in (("overlap", 0.6), ("jaccard", 0.5)):
        size = lambda x, y, m=measure: min(len(x), len(y)) if m == "overlap" else len(x | y)          # noqa: E731
        want = {(a[0], b[0]) for a, b in itertools.combinations(sets, 2) if a[1] and a[1] == b[1] and len(set(a[2]) & set(b[2])) >= share * size(set(a[2]), set(b[2])) - 1e-9}
        for few in (0, fuzzy.FEW, 1000):
            monkeypatch.setattr(fuzzy, "FEW", few)
            got = [tuple(sorted(r)) for r in fuzzy.similar_pairs(df, "block", share, measure).collect()]
            assert len(got) == len(set(got)) and set(got) == want
        monkeypatch.undo()


def test_nodes_like_no_other_are_in_no_round(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(fuzzy, "cut", lambda df, f=fuzzy.cut: (lambda d: sizes.append(d.count()) or d)(f(df)))
    nodes = spark.range(500).selectExpr("id AS node", "id AS rank")
    got = {x["node"]: x["lead"] for x in fuzzy.first_leaders(nodes, spark.createDataFrame([(3, 7)], "a bigint, b bigint")).collect()}
    assert got == {**{i: i for i in range(500)}, 7: 3} and max(sizes) <= 2


def test_deals_are_dealt_out_in_a_stated_number_of_parts(spark):
    t = Tables(spark, "/nowhere")
    t.__dict__["deals"] = spark.range(40).selectExpr("CAST(id AS string) AS id")
    assert t.spread_deals.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_texts_are_read_before_the_chains_are_joined(spark):
    listings = spark.createDataFrame([(1, "s", "u", 1, "Acme Grill", "every", "Half price wings on Tuesdays. DINE-IN ONLY.", None), (2, "s", "u", 1, "Nobody", "every", "Half price wings on Tuesdays.", None), (3, "s", "u", 1, "Nobody", "every", "Win gift cards.", None)],
                                     "id int, source string, url string, day int, brand string, section string, text string, modified date")
    chains = spark.createDataFrame([("Acme Grill", "c1", 9)], "alias string, chain string, places bigint")
    d = job_roundup_offers(listings, chains, F.lit("2026-01-01").cast("date"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("dine")                          # the plan is written from the result down
    assert {r.id: (r.reason, r.conditions) for r in d.collect()} == {1: (None, ["dine-in only"]), 2: ("the chain has no mapped place", []), 3: ("a gift card, points or sweepstakes offer", [])}


def test_a_restriction_is_found_by_its_signs(spark):
    said = ["Rewards MEMBERS", "registered user", "rewards program", "members who", "Prime Members", "in-app offer", "App-only", "with the app", "Dine in only", "when you dine in", "only for dine-in", "sign in to your account", "account required", "need an account",
            "only at the bar", "Bar-area only", "served at the bar", "a bar special", "with any purchase", "takeout or delivery only", "when you order takeout or delivery", "In-store only", "valid in store", "Participating", "some locations", "most locations", "select spots",
            "many restaurants", "some stores", "varies by location", "typically", "may vary", "limited-time", "for a limited time", "per adult entrée", "with an ADULT meal", "purchase an adult entree", "While Supplies Last", "membership needed"]
    rows = spark.createDataFrame([(x,) for x in [*said, ""]], "t string").select("t", labels_of(F.col("t"), S.CONDITIONS).alias("all"), labels_of(F.col("t"), S.CONDITIONS, S.CONDITION_SIGNS).alias("got"), standing_conditions(F.col("t")).alias("shown")).collect()
    assert all(r["all"] == r["got"] for r in rows) and {x for r in rows for x in r["got"]} == {label for _, label in S.CONDITIONS}


def test_names_of_one_and_more_words_in_short_texts(spark):
    names = spark.createDataFrame([("a", "Acme", False, False), ("b", "Bolt & Nut", False, False)], "entry string, name string, event boolean, brand boolean")
    texts = spark.createDataFrame([(1, "the BOLT & NUT's days at '-Acme's-."), (2, ""), (3, None), (4, "Acme"), (5, "Bolt &")], "id int, text string")
    assert sorted((r.id, r.entry, r["at"]) for r in jn_dictionary_scan(texts, names).collect()) == [(1, "a", 6), (1, "b", 1), (4, "a", 0)]
    assert jn_dictionary_scan(texts, names.limit(0)).collect() == []


def test_every_match_has_the_words_it_is_searched_by(spark):
    titles = ["BUY 2 get 30% off", "Buy 3+, and save $20", "buy one get 50% off 2nd", "BoGo sale", "BOGO Free", "B2G1 Free", "b 1 g 1 half off", "Buy Two, Get One Free", "buy 1 get 140% off", "buy 2 get 25% off", "Extra 20% off", "add'l. 5%", "ADDITIONAL 7%", "take an extra 9%", "Another 4%",
              "Up To an extra 40%", "upto 30%", "$20 OFF $100+", "up to $30 off orders of $99", "$15 instant rebate", "SAVE up to $40", "Spend $50, get $10 gift card", "SPEND $75 on shoes, and receive a $15 credit", "20% Off your order of $60", "20% off orders $60+", "25% off $80", "Toys 30% off + FREE Shipping w/ $35",
              "Shoes 10% off and free S&H", "Hats $5 off & $4.99 shipping", "Hats + shipping varies", "Bags 25% off plus Store Pickup", "Game + Digital Download", "Toys | 20% off", "Toys 20% off (select)", "Toys (20% off)", "Sale: Up to 20% off", "Shirts 20% to 40% off", "a+ 20% - 30% off", "", "no offer"]
    posts = spark.createDataFrame([(i, x) for i, x in enumerate([*titles, None])], "id int, title string")
    searched = [*R.WORDS, R.BOGO, R.BOGO_GLUED, R.BOGO_WORD]
    hit = posts.select("title", *[F.col("title").rlike(ww.ci(rx)).alias(f"m{i}") for i, rx in enumerate(searched)], *[ww.may_match(F.col("title"), rx).alias(f"w{i}") for i, rx in enumerate(R.WORDS)], F.col("title").rlike(ww.ci(R.BOGO_START)).alias("start")).collect()
    n = len(R.WORDS)
    assert all(r[f"w{i}"] for r in hit for i in range(n) if r[f"m{i}"]) and all(r["start"] for r in hit for i in range(n, n + 3) if r[f"m{i}"])
    assert all(any(r[f"m{i}"] for r in hit) for i in range(n + 3))                   # each pattern is found in some title
    now = sales.job_sale_offer(posts).collect()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(R, "WORDS", {})
        m.setattr(R, "BOGO_START", "")
        assert sorted(map(str, sales.job_sale_offer(posts).collect())) == sorted(map(str, now))
