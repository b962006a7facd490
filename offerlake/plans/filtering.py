"""Queries of the filters, projections, scores, orders and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fn_ad_end_local, fn_ad_start_local, sc_online, sc_regular, sc_sale_rank, sc_top_rank
from ..functions.amounts import rounded
from ..operators import filters as ops
from ..operators import orders, sets
from ..session import cut
from .catalog import query
from .inputs import Tables, rnd, using

ZONE = "America/Chicago"


def tally(df: DataFrame, number: str = "item", reason: str = "reason") -> DataFrame:
    """Rows by reason, with a checksum of which rows they are."""
    return (df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason"))
            .agg(F.count("*").alias("n"), F.sum(F.col(number).cast("bigint")).alias("checksum")))


def tally_sql(case: str, table: str, number: str = "item") -> str:
    return (f"SELECT coalesce({case}, 'kept') AS reason, count(*) AS n, CAST(sum({number}) AS BIGINT) AS checksum "
            f"FROM {table} GROUP BY 1")


@query("flt_reason", using("deals", body=tally_sql(
    "CASE WHEN pct IS NULL THEN 'no saving' WHEN price < 1000 THEN 'too cheap' WHEN hedge <> '' THEN 'hedged' END", "deals")))
def _(t: Tables):
    return tally(ops.flt_reason(t.deals, [("no saving", F.col("pct").isNull()), ("too cheap", F.col("price") < 1000),
                                          ("hedged", F.col("hedge") != "")]))


JUNK = {1: "", 2: "DKSPT_COVER-BANNER", 3: "Limit 2 per customer", 4: "page"}


@query("flt_junk_item", using("deals", body=tally_sql(
    "CASE line WHEN 4 THEN 'page element, not an item' WHEN 1 THEN 'no item name' WHEN 2 THEN 'placeholder code, not an item' "
    "WHEN 3 THEN 'fine print, not an item' END", "deals")))
def _(t: Tables):
    name = F.when(F.col("line") == 1, " ").when(F.col("line") == 2, JUNK[2]).when(F.col("line") == 3, JUNK[3]).otherwise(F.col("title"))
    return tally(ops.flt_junk_item(t.deals.withColumns(
        {"name": name, "display_type": F.when(F.col("line") == 4, 5).when(F.col("line") == 5, F.lit(None)).otherwise(1)})))


@query("flt_window_overlap", using("deals", body=tally_sql(
    "CASE WHEN least(timezone('America/Chicago', date_trunc('day', valid_to) + INTERVAL 86399 SECOND), "
    "timezone('America/New_York', date_trunc('day', valid_to) + INTERVAL 86399 SECOND)) "
    "< TIMESTAMPTZ '1998-06-01 15:00:00+00' THEN 'item already ended' "
    "WHEN timezone('America/Chicago', date_trunc('day', valid_from)) > TIMESTAMPTZ '1998-06-08 15:00:00+00' "
    "THEN 'item starts after the window' END", "deals")))
def _(t: Tables):
    zone = F.lit(ZONE)
    # the ad states its days in the zone of its publisher, as an offset that follows daylight time there
    stated = lambda c, clock: F.date_format(F.to_utc_timestamp(F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit(clock)).cast("timestamp"),
                                                               "America/New_York"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    d = t.deals.withColumns({"raw_from": stated("valid_from", " 00:00:00"), "raw_to": stated("valid_to", " 23:59:59")})
    d = d.withColumns({"start_local": fn_ad_start_local(F.col("raw_from"), zone), "end_local": fn_ad_end_local(F.col("raw_to"), zone),
                       "ends": F.col("raw_to").cast("timestamp")})
    return tally(ops.flt_window_overlap(d, F.lit("1998-06-01 15:00:00").cast("timestamp"),
                                        F.lit("1998-06-08 15:00:00").cast("timestamp")))


NOW = "2024-01-20 12:00:00"


def now(text: str = NOW):
    return F.lit(text).cast("timestamp")


@query("flt_fresh_post", using("posts", body=tally_sql(
    f"CASE WHEN (expires_stated AND expires_at < TIMESTAMP '{NOW}') OR k = 50 THEN 'expired' "
    f"WHEN NOT (posted_at >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR OR coalesce(expires_stated AND expires_at > TIMESTAMP '{NOW}', "
    "false)) THEN 'older than 72 hours' END", "posts", "id")))
def _(t: Tables):
    title = F.concat(F.lit("A bolt for $"), F.col("price").cast("string"), F.when(F.col("k") == 50, " (sold out)").otherwise(""))
    return tally(ops.flt_fresh_post(t.posts.withColumn("title", title), now()), "id")


@query("flt_sale_live", using("posts", body=tally_sql(
    f"CASE WHEN expires_at < TIMESTAMP '{NOW}' THEN 'sale: ended' "
    f"WHEN TIMESTAMP '{NOW}' - posted_at > INTERVAL 10 DAY THEN 'sale: posted over 10 days ago' "
    f"WHEN expires_at IS NULL AND TIMESTAMP '{NOW}' - posted_at > INTERVAL 3 DAY THEN "
    "'sale: no end date and posted over 3 days ago' "
    f"WHEN k % 7 = 0 AND posted_at > TIMESTAMP '{NOW}' + INTERVAL 2 DAY THEN 'sale: starts after the next 2 days' END",
    "posts", "id")))
def _(t: Tables):
    p = t.posts.withColumns({"starts_at": F.when(F.col("k") % 7 == 0, F.col("posted_at")), "ends_at": F.col("expires_at")})
    return tally(ops.flt_sale_live(p, now(), 10, 3, 2), "id")


@query("flt_between_moments", using("posts", body=tally_sql(
    f"CASE WHEN k % 5 <> 0 AND posted_at > TIMESTAMP '{NOW}' THEN 'not yet' WHEN expires_at < TIMESTAMP '{NOW}' THEN 'over' END",
    "posts", "id")))
def _(t: Tables):
    p = t.posts.withColumns({"shown_from": F.when(F.col("k") % 5 != 0, F.col("posted_at")), "shown_until": F.col("expires_at")})
    return tally(ops.flt_between_moments(p, now()), "id")


@query("flt_category_any", using("deals", body=tally_sql(
    "CASE WHEN NOT (category IN ('PROMO', 'SMALL') OR brand IN ('PROMO', 'SMALL')) THEN 'other category' END", "deals")))
def _(t: Tables):
    return tally(ops.flt_category_any(t.deals.withColumn("categories", F.array("category", "brand")), ["PROMO", "SMALL"]))


# One wording per reason, in the order they are tried; a line's number picks one.
SALE_TITLES = ["{p}% off gift cards at a store", "{p}% off a yearly membership", "Plan: $5 per month", "{p}% off with our credit card",
               "Trade-in sale: {p}% off", "Sign-up sale: {p}% off", "Student discount: {p}% off", "{p}% off hotel sale",
               "Store sweepstakes {p}% off", "{p}% off auction", "{p}% off haircuts", "{p}% off all toys + free store pickup",
               "{p}% off toys, in-store only", "{p}% off ebooks sale", "The best sales this week", "Toys sale", "Fall sale: {p}% off",
               "Up to {p}% off everything"]
SALE_REASONS = ["a gift card", "a membership", "a subscription", "a credit card offer", "a trade-in", "a sign-up offer",
                "a discount for a group of people", "travel", "a giveaway", "an auction", "a local service", "pickup only",
                "in stores only", "digital, not shipped", "a roundup of other deals", "no discount stated", None, None]


@query("flt_not_sale", using("deals", body=tally_sql(
    "CASE item % 20 " + " ".join(f"WHEN {i} THEN " + (f"'{r}'" if r else "NULL") for i, r in enumerate(SALE_REASONS))
    + " WHEN 18 THEN 'one product, not a sale' ELSE 'one product, not a sale' END", "deals")))
def _(t: Tables):
    from ..operators.sales import job_sale_offer
    pick = F.col("item") % 20
    title = F.lit("Office Chair: $45 off")
    for i, text in enumerate(SALE_TITLES):
        a, b = text.split("{p}") if "{p}" in text else (text, None)
        said = F.concat(F.lit(a), F.col("size").cast("string"), F.lit(b)) if b is not None else F.lit(a)
        title = F.when(pick == i, said).otherwise(title)
    posts = t.spread_deals.select("id", "item", title.alias("title"), F.lit("").alias("text"),
                           F.when(pick == 18, "product").otherwise("").alias("deal_type"))
    return tally(ops.flt_not_sale(job_sale_offer(posts)))


@query("flt_not_promo", using("deals", body=tally_sql(
    "CASE WHEN line IN (1, 3, 6) THEN 'promotion: gift card, subscription, game or merchandise' END", "deals")))
def _(t: Tables):
    ends = F.element_at(F.array(*[F.lit(x) for x in (" gift card", " for $3 today", " sweepstakes", " on Fridays", " with fries",
                                                     " at Walmart", " combo")]), F.col("line"))
    return tally(ops.flt_not_promo(t.deals.withColumn("title", F.concat("title", ends))))


@query("flt_storewide", using("deals", body=tally_sql(
    "CASE WHEN line IN (1, 2, 5, 7) THEN 'storewide sale or many products' END", "deals")))
def _(t: Tables):
    ends = F.element_at(F.array(*[F.lit(x) for x in (" up to 30%", " deals at Store", " for $30", " clearance deal", " 20% off sitewide",
                                                     " now 20% off", " extra 20% off")]), F.col("line"))
    return tally(ops.flt_storewide(t.deals.withColumn("title", F.concat("title", ends))))


@query("flt_min_saving", using("deals", body=tally_sql(
    "CASE WHEN coalesce(pct, 0) < 3 THEN 'saving too small' WHEN pct >= 9 THEN 'saving not believable' END", "deals")))
def _(t: Tables):
    return tally(ops.flt_min_saving(t.deals, 3.0, 9.0))


@query("flt_implausible", using("deals", body=tally_sql(
    "CASE WHEN pct >= 8 AND basis <> 'store_regular' THEN 'implausible saving' END", "deals")))
def _(t: Tables):
    return tally(ops.flt_implausible(t.deals, 8.0))


@query("flt_placeholder_expiry", using("posts", body=tally_sql(
    "CASE WHEN e IS NULL THEN 'no expiry' WHEN p THEN 'placeholder expiry' END",
    """(SELECT id, CASE WHEN k % 4 <> 3 THEN 1 END AS e, k % 4 = 0 AND k % 3 < 2 OR k % 4 = 1 AND k % 3 = 1 AND k < 100
             AND (k % 9 * 60) < 120 AS p FROM posts)""", "id")))
def _(t: Tables):
    # k%4: 0 a placeholder (30 d, or 7 d an hour early, or 5 d), 1 some minutes off 90 d, 2 a day off, 3 none
    k = F.col("k")
    days = (F.when((k % 4 == 0) & (k % 3 == 0), 30).when((k % 4 == 0) & (k % 3 == 1), 7).when((k % 4 == 1) & (k % 3 == 1), 90)
            .otherwise(5))
    secs = (F.when((k % 4 == 0) & (k % 3 == 1), -3600).when(k % 4 == 1, k % 9 * 60).when(k % 4 == 2, 86400).otherwise(3))
    ends = F.col("posted_at") + F.make_dt_interval(days, F.lit(0), F.lit(0), secs)
    return tally(ops.flt_placeholder_expiry(t.posts.withColumn("expires_at", F.when(k % 4 != 3, ends))), "id")


@query("flt_product_link", using("deals", body=tally_sql(
    "CASE WHEN line IN (3, 4, 5) THEN 'no product page' END", "deals")))
def _(t: Tables):
    tails = F.element_at(F.array(*[F.lit(x) for x in ("/p/", "/shop/p/", "/weekly-ad/", "/deals/x?d=", "/about-", "/item.html?pid=",
                                                      "/sku/")]), F.col("line"))
    url = F.concat(F.lit("https://www.store"), F.col("merchant").cast("string"), F.lit(".com"), tails, (F.col("item") % 100).cast("string"))
    return tally(ops.flt_product_link(t.deals.withColumn("url", url)))


@query("flt_foreign_host", tally_sql(
    "CASE WHEN page_id % 10 = 0 THEN 'not a shop''s own site' WHEN page_id % 10 = 1 THEN 'no site' "
    "WHEN regexp_matches(url, '^https?://[^/]*example[.]net') THEN 'read elsewhere' END", "pages", "page_id"))
def _(t: Tables):
    url = (F.when(F.col("page_id") % 10 == 0, "https://www.facebook.com/some-shop").when(F.col("page_id") % 10 == 1, "")
           .otherwise(F.col("url")))
    covered = t.spark.createDataFrame([("example.net",), ("example.edu",)], "domain string")
    return tally(ops.flt_foreign_host(t.read("pages").withColumn("url", url), covered), "page_id")


@query("flt_own_site", tally_sql("CASE WHEN line IN (3, 6) THEN 'not the shop''s own address' END",
                                 "(SELECT s_suppkey % 7 + 0 AS line, s_suppkey AS item FROM supplier)"))
def _(t: Tables):
    s = t.read("supplier").select((F.col("s_suppkey") % 7).alias("m"), F.col("s_suppkey").alias("item"), F.col("s_suppkey").cast("string").alias("k"))
    host = (F.when(F.col("m") == 0, F.concat(F.lit("boltworks"), "k", F.lit(".com")))
            .when(F.col("m") == 1, F.concat(F.lit("shop.bolt-works"), "k", F.lit(".com")))
            .when(F.col("m") == 2, F.lit("works.example.com")).when(F.col("m") == 3, F.lit("maker.com"))
            .when(F.col("m") == 4, F.lit("mybolts.org")).when(F.col("m") == 5, F.lit("store.bolt.com")).otherwise(F.lit("store.com")))
    name = (F.when(F.col("m") == 4, F.lit("The Bolts Store")).when(F.col("m") == 5, F.lit("Bolt"))
            .otherwise(F.concat(F.lit("Bolt Works "), "k")))
    return tally(ops.flt_own_site(s.withColumns({"host": host, "name": name})))


@query("flt_stale_answer", using("posts", body=tally_sql(
    f"""CASE WHEN answer IN (SELECT answer FROM (SELECT DISTINCT seller AS answer, source AS ad FROM posts
             EXCEPT SELECT seller, source FROM posts WHERE k < 60)) THEN 'misses an ad expected there'
        WHEN EXISTS (SELECT 1 FROM posts p WHERE p.seller = answer AND p.k < 60 AND p.expires_at > read_at
             AND p.expires_at < TIMESTAMP '{NOW}') THEN 'holds items that ended since' END""",
    "(SELECT seller AS answer, min(posted_at) + INTERVAL 12 DAY AS read_at, seller AS item FROM posts GROUP BY seller)")))
def _(t: Tables):
    p = t.posts
    answers = p.groupBy(F.col("seller").alias("answer")).agg((F.min("posted_at") + F.make_dt_interval(F.lit(12))).alias("read_at"))
    items = p.where("k < 60").select(F.col("seller").alias("answer"), F.col("source").alias("ad"), F.col("expires_at").alias("ends"))
    expected = p.select(F.col("seller").alias("answer"), F.col("source").alias("ad"))
    return tally(ops.flt_stale_answer(answers, items, expected, now()), "answer")


@query("prj_coalesce_sources", """
    SELECT title, story, count(*) AS n FROM (
      SELECT CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 3 = 0 THEN p_brand END AS title,
             CASE WHEN p_size % 5 = 0 THEN 'sale' WHEN p_size % 3 = 0 THEN p_type END AS story FROM part) GROUP BY ALL""")
def _(t: Tables):
    part = t.read("part")
    listing = part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("title"),
                          F.when(F.col("p_size") % 5 == 0, "sale").alias("story"))
    hit = part.where("p_size % 3 = 0").select("p_partkey", F.col("p_brand").alias("title"), F.col("p_type").alias("story"))
    return (ops.prj_coalesce_sources(listing, hit, ["p_partkey"], ["title", "story"]).groupBy("title", "story")
            .agg(F.count("*").alias("n")))


@query("prj_kind", using("deals", body=tally_sql(
    "CASE WHEN line = 7 THEN 'regular' WHEN hedge <> '' OR line IN (5, 6) THEN 'promotion' ELSE 'deal' END", "deals")))
def _(t: Tables):
    d = t.deals.withColumns({"is_regular": F.col("line") == 7, "promo": F.when(F.col("line") == 6, True),
                             "bogo": F.when(F.col("line") == 5, "buy 1 get 1 free")})
    return tally(ops.prj_kind(d), reason="kind")


@query("prj_day_labels", using("deals", body=f"""
    SELECT starts_in_days, ends_in_days, count(*) AS n FROM (
      SELECT greatest(0, date_diff('day', CAST(timezone('{ZONE}', TIMESTAMPTZ '1998-06-02 03:00:00+00') AS DATE),
                                          CAST(timezone('{ZONE}', timezone('UTC', valid_from)) AS DATE))) AS starts_in_days,
             date_diff('day', CAST(timezone('{ZONE}', TIMESTAMPTZ '1998-06-02 03:00:00+00') AS DATE),
                              CAST(timezone('{ZONE}', timezone('UTC', valid_to)) AS DATE)) AS ends_in_days FROM deals)
    GROUP BY ALL"""))
def _(t: Tables):
    d = ops.prj_day_labels(t.deals, F.lit("1998-06-02 03:00:00").cast("timestamp"), F.lit(ZONE))
    return d.groupBy("starts_in_days", "ends_in_days").agg(F.count("*").alias("n"))


@query("flt_partition_lists", using("deals", body=tally_sql(
    "CASE WHEN merchant % 3 = 0 THEN 'unconfirmed' WHEN hedge <> '' THEN 'promotions' WHEN merchant % 3 = 1 THEN 'deals' "
    "ELSE 'left out' END", "deals")))
def _(t: Tables):
    d = t.deals.withColumns({"store_status": F.when(F.col("merchant") % 3 == 0, "unmapped").when(F.col("merchant") % 3 == 1, "nearby")
                             .otherwise("far"), "kind": F.when(F.col("hedge") != "", "promotion").otherwise("deal")})
    return tally(ops.flt_partition_lists(d).withColumn("list", F.coalesce("list", F.lit("left out"))), reason="list")


# --- scores ---

def spread(score: str) -> list:
    return [F.count("*").alias("n"), F.sum((F.col(score) * 100 + 0.5).cast("bigint")).alias("cents"), F.max(score).alias("best")]


SPREAD = "count(*) AS n, CAST(sum(CAST(floor({s} * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents, max({s}) AS best"


@query("sc_local", using("scored", body=f"SELECT category, basis, {SPREAD.format(s='score')} FROM scored GROUP BY category, basis"))
def _(t: Tables):
    return t.scored.groupBy("category", "basis").agg(*spread("score"))


@query("sc_online", using("deals", body=f"""
    SELECT category, line, {SPREAD.format(s='score')} FROM (SELECT *, {rnd('''
      coalesce(pct, 0.0::DOUBLE) * (CASE basis WHEN 'store_regular' THEN 0.9 WHEN 'claimed_savings' THEN 0.6 WHEN 'list' THEN 0.5
      ELSE 0.0 END)::DOUBLE * greatest(CASE WHEN line = 7 THEN 0.15::DOUBLE ELSE 1 - 0.08::DOUBLE * (len(conditions) + CASE WHEN line
      = 6 THEN 1 ELSE 0 END) - (CASE WHEN line = 6 THEN 0.2 ELSE 0.0 END)::DOUBLE END, 0.15::DOUBLE)''')} AS score FROM deals)
    GROUP BY category, line"""))
def _(t: Tables):
    more = (F.when(F.col("line") == 6, F.array(F.lit("price varies by size or color")))
            .when(F.col("line") == 7, F.array(F.lit("out of stock at the store when checked"))).otherwise(F.array().cast("array<string>")))
    score = sc_online(F.col("pct"), F.col("basis"), F.concat("conditions", more))
    return t.deals.withColumn("score", score).groupBy("category", "line").agg(*spread("score"))


RANK = """
    (CASE WHEN best > 0 THEN floor(best * 10 + 0.5) / 10 END)"""


@query("sc_sale_rank", using("deals", body=f"""
    SELECT category, line, count(*) AS n, CAST(sum(CAST(floor({RANK} * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents,
           max({RANK}) AS best
    FROM (SELECT category, line, greatest(CASE WHEN upto IS NOT NULL THEN firm + 0.5::DOUBLE * greatest(0.0::DOUBLE, CASE WHEN extra
             IS NULL THEN coalesce(nullif(upto, 0), firm) ELSE 100 * (1 - (1 - coalesce(nullif(upto, 0), pct2, 0.0::DOUBLE) / 100) *
             (1 - extra / 100)) END - firm) ELSE firm END, CASE WHEN line = 5 THEN 50 * savings / regular ELSE 0.0::DOUBLE END) AS best
          FROM (SELECT *, CASE WHEN extra IS NOT NULL THEN 100 * (1 - (1 - coalesce(pct2, 0.0::DOUBLE) / 100) * (1 - extra / 100))
                       ELSE coalesce(pct2, 0.0::DOUBLE) END AS firm
                FROM (SELECT *, CASE WHEN line IN (1, 2) THEN pct END AS pct2, CASE WHEN line IN (3, 4) THEN size::DOUBLE END AS upto,
                             CASE WHEN line IN (2, 4) THEN pct END AS extra FROM deals)))
    GROUP BY category, line"""))
def _(t: Tables):
    on = lambda lines, c: F.when(F.col("line").isin(*lines), F.col(c).cast("double"))          # noqa: E731
    none = F.lit(None).cast("double")
    score = sc_sale_rank(on([1, 2], "pct"), on([3, 4], "size"), on([2, 4], "pct"), none, on([5], "savings"), F.lit(False),
                         on([5], "regular"), none)
    d = t.deals.withColumn("score", score)
    return d.groupBy("category", "line").agg(F.count("*").alias("n"), F.sum((F.col("score") * 100 + 0.5).cast("bigint")).alias("cents"),
                                              F.max("score").alias("best"))


STATUS = ["confirmed", "listed2", "listed", "reported", "yours", "", "confirmed"]
STATUS_W = "(CASE line WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 WHEN 3 THEN 0.75 WHEN 4 THEN 0.7 WHEN 5 THEN 0.5 WHEN 7 THEN 1.0 ELSE 0.0 END)::DOUBLE"


@query("sc_regular", using("deals", body=f"""
    SELECT category, line, {SPREAD.format(s='score')} FROM (SELECT *, {rnd(f'''coalesce(pct, 0.0::DOUBLE) * ((CASE basis WHEN
      'store_regular' THEN 0.9 WHEN 'claimed_savings' THEN 0.6 WHEN 'list' THEN 0.5 ELSE 0.0 END)::DOUBLE * (CASE WHEN hedge <> ''
      THEN 0.5 ELSE 1.0 END)::DOUBLE) * {STATUS_W}''')} AS score FROM deals) GROUP BY category, line"""))
def _(t: Tables):
    status = F.element_at(F.array(*[F.lit(x) for x in STATUS]), F.col("line"))
    score = sc_regular(F.col("pct"), F.col("basis"), F.col("hedge"), status)
    return t.deals.withColumn("score", score).groupBy("category", "line").agg(*spread("score"))


@query("sc_top_rank", using("scored", body=f"""
    SELECT category, kind, {SPREAD.format(s='rank')} FROM (SELECT *, {rnd(f'''CASE kind WHEN 'regular' THEN size2 * trust * {STATUS_W}
      WHEN 'promotion' THEN size2 * trust * 0.7::DOUBLE ELSE score END''')} AS rank
      FROM (SELECT *, CASE WHEN line <= 2 THEN 'regular' WHEN line <= 4 THEN 'promotion' ELSE 'online' END AS kind,
                   CASE WHEN pct IS NOT NULL THEN pct WHEN line = 3 THEN 50.0::DOUBLE ELSE 100.0::DOUBLE END AS size2,
                   (CASE basis WHEN 'claimed_savings' THEN 0.6 WHEN 'list' THEN 0.5 ELSE 0.9 END)::DOUBLE *
                   (CASE WHEN hedge <> '' THEN 0.5 ELSE 1.0 END)::DOUBLE AS trust FROM scored))
    GROUP BY category, kind"""))
def _(t: Tables):
    from ..functions import badge_size
    kind = F.when(F.col("line") <= 2, "regular").when(F.col("line") <= 4, "promotion").otherwise("online")
    status = F.element_at(F.array(*[F.lit(x) for x in STATUS]), F.col("line"))
    conditions = F.when(F.col("line") == 3, F.array(F.lit("with a purchase"))).otherwise(F.array().cast("array<string>"))
    size = badge_size(F.lit(None).cast("double"), F.col("pct"), F.lit("free bolt"), F.col("title"), conditions)
    d = t.scored.withColumns({"kind": kind, "badge": size})
    d = d.withColumn("rank", sc_top_rank(F.col("kind"), F.col("badge"), F.col("basis"), F.col("hedge"), status, F.col("score")))
    return d.groupBy("category", "kind").agg(*spread("rank"))


# --- orders: every row with its place, since a comparison ignores row order ---

def placed(df: DataFrame, *show: str) -> DataFrame:
    """An ordered list with each row's place: the sorted partitions are written down, counted, and each starts after those before it."""
    rows = cut(df.select(*show, F.monotonically_increasing_id().alias("_at")).withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at") % (1 << 33)}))
    sizes, starts, before = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}, [], 0     # a number for each partition
    for part in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(part, 0)
    return rows.select((F.get(F.lit(starts or [0]).cast("array<bigint>"), F.col("_part").cast("int")) + F.col("_row") + 1).alias("place"), *show)


def placed_sql(table: str, order: str, *show: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) AS place, {', '.join(show)} FROM {table}"


@query("srt_local", using("scored", body=placed_sql("scored", "score DESC, coalesce(savings, 0) DESC, title, id", "id", "score")))
def _(t: Tables):
    return placed(orders.srt_local(t.scored), "id", "score")


@query("srt_promotions", using("scored", body=placed_sql("(SELECT *, date_diff('day', DATE '1998-06-01', CAST(valid_to AS DATE)) AS "
                                                        "ends_in_days FROM scored)", "score DESC, ends_in_days, title, id", "id", "score")))
def _(t: Tables):
    d = t.scored.withColumn("ends_in_days", F.datediff(F.to_date("valid_to"), F.lit("1998-06-01").cast("date")))
    return placed(orders.srt_promotions(d), "id", "score")


@query("srt_regular", using("scored", body=placed_sql("(SELECT *, line % 3 AS starts_in_days FROM scored)",
                                                      "starts_in_days, score DESC, merchant, title, id", "id", "score")))
def _(t: Tables):
    return placed(orders.srt_regular(t.scored.withColumn("starts_in_days", F.col("line") % 3)), "id", "score")


@query("srt_sales", using("posts", body=placed_sql("(SELECT *, 'Store' || seller AS store_name FROM posts)",
                                                   "price DESC, expires_at ASC NULLS LAST, lower(store_name), id", "id", "price")))
def _(t: Tables):
    p = t.posts.withColumns({"score": F.col("price"), "ends_at": F.col("expires_at"),
                             "store_name": F.concat(F.lit("Store"), F.col("seller").cast("string"))})
    return placed(orders.srt_sales(p), "id", "price")


@query("srt_city_search", using("cities", body="""
    SELECT id, name, population FROM (SELECT *, CASE WHEN regexp_replace(lower(name), '[^a-z0-9]', '', 'g') LIKE 'customer00000001%'
      THEN 0 WHEN regexp_replace(lower(name), '[^a-z0-9]', '', 'g') LIKE '%customer00000001%' THEN 1 END AS match FROM cities)
    WHERE match IS NOT NULL ORDER BY match, population DESC, id LIMIT 10"""))
def _(t: Tables):
    return orders.srt_city_search(t.cities, "Customer#00000001, TX").select("id", "name", "population")


@query("srt_pick_nine")
def _(t: Tables):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("regular", "promotion", "online", "sale")]), F.col("line") % 4 + 1)
    pool = t.scored.select(kind.alias("kind"), F.col("merchant").cast("string").alias("brand"), F.col("score").alias("rank"), "id",
                           F.lit(None).cast("timestamp").alias("shown_from"), F.col("valid_to").alias("shown_until"))
    return orders.srt_pick_nine(pool, F.lit("1998-06-01").cast("timestamp"))


# --- sets ---

@query("set_union_kinds", """
    SELECT kind, count(*) AS n, count(stars) AS with_stars, count(ends) AS with_ends FROM (
      SELECT 'sale' AS kind, NULL AS stars, ts AS ends FROM events WHERE event_type = 'purchase'
      UNION ALL SELECT 'online', value, NULL FROM events WHERE event_type = 'view'
      UNION ALL SELECT 'regular', p_size, NULL FROM part UNION ALL SELECT 'promotion', NULL, NULL FROM supplier) GROUP BY kind""")
def _(t: Tables):
    e = t.read("events")
    u = sets.set_union_kinds(
        sale=e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("ts").alias("ends")),
        online=e.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("value").alias("stars")),
        regular=t.read("part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("stars")),
        promotion=t.read("supplier").select(F.col("s_suppkey").alias("id")))
    return u.groupBy("kind").agg(F.count("*").alias("n"), F.count("stars").alias("with_stars"), F.count("ends").alias("with_ends"))


@query("set_missing_items", using("deals", body="""
    SELECT merchant, count(*) AS n, CAST(sum(item) AS BIGINT) AS checksum FROM (
      SELECT DISTINCT merchant, item FROM deals WHERE line < 6 EXCEPT SELECT merchant, item FROM deals WHERE line >= 4)
    GROUP BY merchant"""))
def _(t: Tables):
    items = t.deals.where("line < 6").select("merchant", "item").distinct()
    hits = t.deals.where("line >= 4").select("merchant", "item")
    return (sets.set_missing_items(items, hits, ["merchant", "item"]).groupBy("merchant")
            .agg(F.count("*").alias("n"), F.sum("item").alias("checksum")))


@query("set_covered_ads", using("deals", body="""
    SELECT area, CAST(count(*) FILTER (WHERE first = area) AS BIGINT) AS new_ads, max(CASE WHEN first = area THEN 1 ELSE 0 END) AS search,
           seller FROM (SELECT DISTINCT merchant % 50 AS area, line AS seller, item AS ad, min(merchant % 50) OVER (PARTITION BY line,
             item) AS first FROM deals) GROUP BY area, seller"""))
def _(t: Tables):
    at = t.deals.select((F.col("merchant") % 50).alias("area"), (F.col("merchant") % 50).alias("ord"), F.col("line").alias("seller"),
                        F.col("item").alias("ad"))
    return sets.set_covered_ads(at).select("area", "seller", "new_ads", F.col("search").cast("int").alias("search"))


@query("set_shared", using("deals", body="""
    SELECT *, floor(shared / a_rows::DOUBLE * 1000 + 0.5) / 1000 AS a_share, floor(shared / b_rows::DOUBLE * 1000 + 0.5) / 1000 AS b_share
    FROM (SELECT (SELECT count(DISTINCT item) FROM deals WHERE merchant % 2 = 0) AS a_rows,
                 (SELECT count(DISTINCT item) FROM deals WHERE merchant % 3 = 0) AS b_rows,
                 (SELECT count(*) FROM (SELECT item FROM deals WHERE merchant % 2 = 0 INTERSECT SELECT item FROM deals
                  WHERE merchant % 3 = 0)) AS shared)"""))
def _(t: Tables):
    return sets.set_shared(t.deals.where("merchant % 2 = 0").select("item"), t.deals.where("merchant % 3 = 0").select("item"))
