"""Standing offers brought together, beside a loop over all earlier offers of a chain."""

import random
from collections import Counter
from datetime import date

import pandas as pd
from pyspark.sql import functions as F

from offerlake.functions import fn_offer_words
from offerlake.operators import merging as M
from offerlake.operators.calendar import weekdays_in

SCHEMA = ("id string, chain string, origin string, source string, brand string, offer string, days array<int>, price double, pct double, regular double, bogo string, summary string, until date, url string, "
          "hours string, conditions array<string>, pages array<int>, absorbs array<string>, suppress string, exact_days boolean, monthly string")
THINGS = "wings pizza taco margarita lunch burger pie salad".split()


def offers(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        origin = rnd.choice(["registry", "list", "list", "list", "list"])
        days = sorted(rnd.sample(range(7), rnd.choice([1, 1, 1, 2, 3, 5, 7])))
        things = " and ".join(rnd.sample(THINGS, rnd.randint(1, 2)))
        kind = rnd.randrange(6)
        price = rnd.choice([3.0, 5.0, 5.99, 9.99, 10.09, 14.49])
        offer, terms = {0: (f"BOGO {things}", (None, 50.0, None, "buy 1 get 1 free", "BOGO")), 1: ("BOGO", (None, 50.0, None, "buy 1 get 1 free", "BOGO")), 2: ("Kids eat free" + rnd.choice(["", " here"]), (None, None, None, "", "kids eat free")),
                        3: (f"Half price {things}", (None, 50.0, None, "", "half price")), 4: (f"{things} at ${price:.2f}", (price, None, None, "", f"${price}")),
                        5: (f"The very best {things} with fries at ${price:.2f} in town", (price, 20.0, price * 1.25, "", f"${price}"))}[kind]
        if rnd.random() < 0.2:
            offer += rnd.choice([" on Tuesdays", " every Friday"])
        special = origin == "registry" and rnd.random() < 0.5
        out.append((f"{i:04d}", f"c{rnd.randrange(3)}", origin, f"s{rnd.randrange(3)}", "Acme", offer, days, *terms, date(2026, 1, rnd.randint(1, 28)) if rnd.random() < 0.3 else None, "", rnd.choice(["", "", "2-5"]),
                    rnd.sample(["dine-in only", "in the app", "limited time"], rnd.randint(0, 2)), [rnd.choice(days)], [rnd.choice(THINGS)] if special and rnd.random() < 0.5 else [], "not any more" if special and rnd.random() < 0.3 else "",
                    special and rnd.random() < 0.5, "1:1" if special and rnd.random() < 0.1 else ""))
    return out + [(f"9{r[0]}", *r[1:]) for r in out[::4] if r[2] == "list"]      # some entries twice


def slow(rows, words, named):
    """The order, one by one, over plain sets. Entries of lists that are equal in all but their id are one."""
    equal = Counter(str(r[1:]) for r in rows)
    first = {}
    for r in sorted(rows):
        first.setdefault(str(r[1:]) if r[2] == "list" else r[0], r)
    every = [dict(zip("id chain origin source brand offer days price pct regular bogo summary until url hours conditions pages absorbs suppress exact_days monthly".split(), r), n=equal[str(r[1:])] if r[2] == "list" else 1) for r in first.values()]
    for e in every:
        e.update(w=set(words[e["id"]]), named=named[e["id"]], d=set(e["days"]), p=set(e["pages"]), clash=False, src={e["source"]} if e["origin"] == "list" else set(), end=e["until"])
        e["t"] = {x for x in e["w"] if x != "bogo" and not x.lstrip("$")[:1].isdigit()}
        e["stated"] = e["price"] if e["pct"] is None or e["regular"] is not None else None
    lost = Counter()
    kept_of = {}
    jac = lambda a, b: len(a["w"] & b["w"]) / max(1, len(a["w"] | b["w"]))
    close = lambda a, b: abs(a["stated"] - b["stated"]) <= max(0.05, a["stated"] * 0.02)

    def alike(a, b):
        both = a["t"] & b["t"]
        if a["bogo"] and b["bogo"]:
            return bool(both) or a["w"] <= {"bogo"} or b["w"] <= {"bogo"}
        if a["bogo"] or b["bogo"]:
            return False
        if a["summary"] == "kids eat free" and b["summary"] == "kids eat free":
            return True
        if a["stated"] and b["stated"]:
            return (close(a, b) and bool(both)) or (a["stated"] == b["stated"] and (a["stated"] >= 6 or a["stated"] % 1 != 0))
        return bool(both and a["pct"] and a["pct"] == b["pct"]) or jac(a, b) >= 0.5

    rank = {"registry": 0, "list": 2}
    for e in sorted(every, key=lambda e: (rank[e["origin"]], not e["suppress"], len(e["offer"]), e["offer"], e["id"])):
        hit = False
        for k in kept_of.setdefault(e["chain"], []):
            if e["origin"] != "list" or k["monthly"]:
                continue
            meet = e["d"] & k["d"]
            twin = jac(k, e) >= 0.8 and k["hours"] == e["hours"] and k["named"] == e["named"]
            taken = meet and any(a in e["offer"].lower() for a in k["absorbs"])
            if k["suppress"] and not k["absorbs"] and not twin and not k["t"] & e["t"]:
                continue
            if taken or twin or (meet and alike(k, e)):
                hit = True
                if k["suppress"]:
                    lost["regular deal: " + k["suppress"]] += e["n"]
                    e["d"] = set()
                elif k["origin"] == "registry" and k["stated"] and e["stated"] and k["stated"] != e["stated"]:
                    lost["regular deal: a list gives a different price than the company's own page"] += e["n"]
                    e["d"] = set()
                else:
                    k["src"] = k["src"] | e["src"]
                    if twin and k["origin"] == "list":
                        k["d"], k["p"], e["d"] = k["d"] | e["d"], k["p"] | e["p"], set()
                        k["end"] = min([x for x in (k["end"], e["end"]) if x], default=None)
                    else:
                        e["d"] = e["d"] - k["d"]
                        if taken and k["exact_days"] and e["d"]:
                            lost["regular deal: a list gives other days than the company's own page"] += e["n"] * bool(e["d"] & e["p"])
                            e["d"] = set()
            elif meet and k["origin"] == "list" and k["stated"] and e["stated"] and not close(k, e) and (len(k["t"] & e["t"]) >= 2 or jac(k, e) >= 0.5):
                k["clash"], hit, e["d"] = True, True, set()
                lost["regular deal: lists disagree on the price, so it is not shown"] += e["n"]
            if hit and not e["d"]:
                break
        if hit:
            e["d"] &= e["p"]
        if e["d"] or not hit:
            kept_of[e["chain"]].append(e)
    out = []
    for e in (x for xs in kept_of.values() for x in xs):
        if e["suppress"]:
            continue
        if e["clash"] and len(e["src"]) < 2:
            lost["regular deal: lists disagree on the price, so it is not shown"] += 1
        elif e["origin"] == "list" and len(e["d"]) >= 5 and not e["hours"] and not e["bogo"] and e["pct"] is None and e["summary"] != "kids eat free":
            lost["regular deal: an everyday offer, not tied to a day or time"] += 1
        else:
            out.append((e["id"], tuple(sorted(e["d"])), e["end"], len(e["src"])))
    return sorted(out), {k: v for k, v in lost.items() if v}


def test_equal_to_a_loop_over_all_earlier_offers(spark):
    for seed, n in ((1, 60), (2, 160), (3, 400)):
        rows = offers(seed, n)
        df = spark.createDataFrame(rows, SCHEMA)
        read = df.select("id", fn_offer_words(F.col("offer"), F.col("brand")).alias("w"), weekdays_in(F.col("offer"), every_day=False).alias("d")).collect()
        want, reasons = slow(rows, {r.id: r.w for r in read}, {r.id: r.d for r in read})
        kept, why = M.dd_regular_merge(df)
        got = sorted((r.id, tuple(r.days), r.until, r.sources) for r in kept.collect())
        assert got == want
        assert {r.reason: r.n for r in why.collect()} == reasons
    assert len(reasons) == 4


def test_a_list_with_another_price_than_the_own_page(spark):
    rows = [("a", "c", "registry", "s", "Acme", "Two tacos $9.99", [1], 9.99, None, None, "", "$9.99", None, "", "", [], [1], [], "", False, ""), ("b", "c", "list", "l", "Acme", "Tacos, two for $6.49", [1], 6.49, None, None, "", "$6.49", None, "", "", [], [1], ["tacos"], "", False, "")]
    own = [(*rows[0][:17], ["taco"], *rows[0][18:])]
    kept, why = M.dd_regular_merge(spark.createDataFrame(own + rows[1:], SCHEMA))
    assert [r.id for r in kept.collect()] == ["a"] and [tuple(r) for r in why.collect()] == [("regular deal: a list gives a different price than the company's own page", 1)]


def test_lists_that_dispute_a_restriction_are_named(spark):
    base = ("Acme", "Half price wings on Tuesdays", [1], None, 50.0, None, "", "half price", None, "", "", )
    rows = [("a", "c", "list", "First", *base, ["dine-in only"], [1], [], "", False, ""), ("b", "c", "list", "Second", *base, ["in the app", "limited time"], [1], [], "", False, "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("wording", F.when(F.col("id") == "a", "Half price wings. Dine-in only.").otherwise("Half price wings in the app."))
    kept, _ = M.dd_regular_merge(df)
    assert [(r.id, r.sources, r.conditions) for r in kept.collect()] == [("a", 2, ["dine-in only, says First (Second differs)", "in the app, says Second (First differs)"])]


def test_empty_offers(spark):
    kept, why = M.dd_regular_merge(spark.createDataFrame([], SCHEMA))
    assert kept.collect() == [] and why.collect() == []


def test_a_node_of_64_bits_is_given_back_whole_beside_a_reason():
    fields = ["root", "node", "n", "days", "pages", "until", "words", "price", "pct", "origin", "conditions", "source", "offer", "named", "bogo", "summary", "hours", "suppress", "absorbs", "monthly",
              "exact_days", "hours_vary", "cue_days", "cue_conditions", "wording"]
    entry = lambda node, origin, price: (1, node, 1, 2, 2, None, ["two", "taco"], price, None, origin, [], "s", "two tacos", "", "", "", "", "", [], "", False, False, 0, [], "two tacos")     # noqa: E731
    node = 2 ** 62 + 1
    out = list(M.settle_classes(iter([pd.DataFrame([entry(node, "registry", 9.99), entry(5, "list", 6.49)], columns=fields)])))[0]
    assert out["node"].dropna().tolist() == [node] and out["reason"].dropna().tolist() == [M.OTHER_PRICE]
