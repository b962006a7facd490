import random

from offerlake.operators.identity import jn_price_band


def test_the_cheapest_believable_listing_of_each_site(spark):
    rnd = random.Random(5)
    price = lambda: round(10 ** rnd.uniform(-2, 4), 2)
    lots = list({(f"p{rnd.randrange(6)}", f"s{rnd.randrange(4)}", price()) for _ in range(1500)}) + [("p0", "s0", 0.35), ("p0", "s0", 35.0), ("p9", "s1", 5.0)]
    asked = list({(f"p{rnd.randrange(7)}", price()) for _ in range(400)}) + [("p0", 1.0), ("p0", 100.0), ("p8", 3.0)]
    got = jn_price_band(spark.createDataFrame(asked, "listing_sig string, deal_price double"), spark.createDataFrame(lots, "listing_sig string, site string, listing_price double"))
    want = set()
    for sig, p in asked:
        for site in {s for x, s, _ in lots if x == sig}:
            best = min((v for x, s, v in lots if x == sig and s == site and 0.35 * p <= v <= 3.0 * p), default=None)
            if best is not None:
                want.add((sig, p, site, best))
    rows = [tuple(r) for r in got.select("listing_sig", "deal_price", "site", "listing_price").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
