"""Queries of the data-quality checks. Faults are planted by number, so the oracle knows which rows must fail and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import quality as q
from ..operators.sales import job_sale_offer, stated_end, stated_range
from .catalog import query
from .inputs import Tables, miles_sql, using
from .wording import case, sale_posts


def summary(df: DataFrame, number: str = "item") -> DataFrame:
    return (df.groupBy("verdict", F.array_join("issues", "; ").alias("issues")).agg(F.count("*").alias("n"), F.sum(F.col(number).cast("bigint")).alias("checksum")))


def summary_sql(issues: str, table: str, number: str = "item", unclear: str = "NULL") -> str:
    return (f"SELECT CASE WHEN u IS NOT NULL THEN 'inconclusive' WHEN i = '' THEN 'pass' ELSE 'fail' END AS verdict, coalesce(u, i) AS issues, count(*) AS n, CAST(sum(x) AS BIGINT) AS checksum "
            f"FROM (SELECT {issues} AS i, {unclear} AS u, {number} AS x FROM {table}) GROUP BY ALL")


def some(*pairs: tuple[str, str]) -> str:
    """Issues joined in order, where each condition holds."""
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in pairs) + ")"


@query("dq_math", using("deals", body=summary_sql(some(
    ("percent doesn''t follow from the prices", "line = 1 AND pct IS NOT NULL"), ("saving doesn''t follow from the prices", "line = 2"), ("a buy-and-get offer not read as one", "line = 3"),
    ("percent differs from the source", "line = 1 AND pct IS NOT NULL OR (line = 4 AND pct IS NOT NULL)"), ("saving differs from the source", "line = 2 AND basis <> 'list'"), ("regular price differs from the source", "line = 5")), "deals")))
def _(t: Tables):
    c = F.col
    shown = t.deals.select("id", "item", "price", "regular", F.when(c("line") == 1, c("pct") + 5).otherwise(c("pct")).alias("pct"), F.when(c("line") == 2, c("savings") + 1).otherwise(c("savings")).alias("savings"),
                           F.lit("").alias("bogo"), F.lit(1).alias("qty"), "basis")
    src = t.deals.select("id", F.when(c("line") == 4, c("pct") + 2).otherwise(c("pct")).alias("percent_off"), c("savings").alias("dollars_off"), F.when(c("line") == 5, c("regular") + 1).otherwise(c("regular")).alias("original_price"),
                         F.when(c("line") == 3, "Buy 2 get 1 now").otherwise("now").alias("text"))
    return summary(q.dq_math(shown, src))


@query("dq_window", using("deals", body=summary_sql(some(
    ("outside the window", "valid_to < TIMESTAMP '1998-06-01' OR valid_from > TIMESTAMP '1998-12-01'"), ("''ends in'' label is wrong", "line = 2"), ("''starts in'' label is wrong", "line = 3")), "deals", unclear="CASE WHEN line = 7 THEN 'the source gives no dates' END")))
def _(t: Tables):
    c, today = F.col, F.lit("1998-06-01").cast("date")
    ends, starts = F.datediff(F.to_date("valid_to"), today), F.greatest(F.lit(0), F.datediff(F.to_date("valid_from"), today))
    shown = t.deals.select("id", "item", F.when(c("line") == 2, ends + 1).otherwise(ends).alias("ends_in_days"), F.when(c("line") == 3, starts + 1).otherwise(starts).alias("starts_in_days"))
    src = t.deals.select("id", c("valid_from").alias("start_local"), F.when(c("line") != 7, c("valid_to")).alias("end_local"), F.to_date("valid_from").alias("start_day"), F.to_date("valid_to").alias("end_day"), today.alias("today"))
    return summary(q.dq_window(shown, src, F.lit("1998-06-01").cast("timestamp"), F.lit("1998-12-01").cast("timestamp")))


@query("dq_fidelity", using("deals", body=summary_sql(some(
    ("the item no longer exists at the source", "line = 7"), ("merchant", "line = 1"), ("title", "line = 2"), ("price", "line IN (1, 3)"), ("dates", "line = 4")), "deals")))
def _(t: Tables):
    c = F.col
    shown = t.deals.select("id", "item", F.when(c("line") == 2, F.concat("title", F.lit("s"))).otherwise(F.upper("title")).alias("title"), "merchant", "price", "valid_from", "valid_to")
    src = t.deals.where("line <> 7").select("id", "title", F.when(c("line") == 1, c("merchant") + 1).otherwise(c("merchant")).alias("merchant"), F.when(c("line").isin(1, 3), c("price") + 1).otherwise(c("price")).alias("price"),
                                            "valid_from", F.when(c("line") == 4, c("valid_from")).otherwise(c("valid_to")).alias("valid_to"))
    return summary(q.dq_fidelity(shown, src))


@query("dq_vicinity", using("cities", "places", body=f"""
    WITH d AS (SELECT id, nation AS chain, lat, lon FROM cities), listed AS (SELECT * FROM places WHERE chain % 5 <> 0 AND NOT (chain % 5 = 1 AND merchant % 3 <> 0)),
    c AS (SELECT chain, count(*) AS m, count(*) FILTER (WHERE chain % 5 <> 0 AND NOT (chain % 5 = 1 AND merchant % 3 <> 0)) AS l FROM places GROUP BY chain)
    """ + summary_sql("CASE WHEN near THEN '' ELSE 'the chain''s own list shows no branch within the radius' END",
                      f"(SELECT d.*, c.m, coalesce(c.l, 0) AS l, EXISTS (SELECT 1 FROM listed p WHERE p.chain = d.chain AND {miles_sql('d', 'p')} <= 120) AS near FROM d LEFT JOIN c USING (chain))", "id",
                      "CASE WHEN l = 0 THEN 'no list for this chain' WHEN l < 0.5 * m THEN 'the list looks incomplete' END")))
def _(t: Tables):
    listed = t.places.where("chain % 5 <> 0 AND NOT (chain % 5 = 1 AND merchant % 3 <> 0)").select("chain", "lat", "lon")
    mapped = t.places.groupBy("chain").agg(F.count("*").alias("places"))
    return summary(q.dq_vicinity(t.cities.select("id", F.col("nation").alias("chain"), "lat", "lon"), listed, mapped, 120.0), "id")


@query("dq_ranking", using("posts", body="WITH l AS (SELECT p.*, b.price AS before FROM posts p LEFT JOIN posts b ON b.id = p.id - 1), d AS (SELECT k, seller, count(*) AS same FROM posts GROUP BY ALL) " + summary_sql(some(
    ("market basis without two comparisons", "k % 4 = 0 AND k % 3 < 2"), ("percent doesn''t follow from the reference", "k % 4 = 1"), ("a sale on many products in the product list", "k % 9 = 0"),
    ("older than 72 hours with no later end", "NOT (posted_at >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 73 HOUR OR coalesce(expires_at > TIMESTAMP '2024-01-20 12:00:00', false))"),
    ("ranked above a better one", "before < price"), ("the same product twice", "same > 1")), "(SELECT l.*, d.same FROM l JOIN d USING (k, seller))", "id")))
def _(t: Tables):
    c, k = F.col, F.col("k")
    d = t.posts.select("id", F.lit("all").alias("list"), c("id").alias("pos"), c("price").alias("score"), F.when(k % 4 == 0, "market").otherwise("list").alias("basis"), F.lit(80.0).alias("price"), F.when(k % 4 == 1, 160.0).otherwise(100.0).alias("reference_price"),
                 F.lit(100.0).alias("market_median"), F.lit(20.0).alias("pct"), F.lit(20.0).alias("verified_pct"), (k % 3).alias("sites"), F.when(k % 9 == 0, "Deals at Store").otherwise("a bolt").alias("title"), "posted_at", "expires_at",
                 F.concat_ws("|", k, "seller").alias("product_key"))
    return summary(q.dq_ranking(d, F.lit("2024-01-20 12:00:00").cast("timestamp")), "id")


@query("dq_comparison", using("deals", body=summary_sql(some(
    ("not the same product", "line = 1"), ("no price on the page", "line = 2"), ("another price", "line IN (1, 3)")), "deals", unclear="CASE WHEN line = 4 THEN 'the page has no product title' END")))
def _(t: Tables):
    c = F.col
    d = t.deals.select("item", (c("line") != 1).alias("same"), "price", F.when(c("line").isin(1, 3), c("price") * 1.05 + 2).when(c("line") != 2, c("price") + 0.5).alias("page_price"), F.when(c("line") != 4, c("title")).alias("page_title"))
    return summary(q.dq_comparison(d))


@query("dq_offer_numbers", using("deals", body=summary_sql(some(
    ("a percent is not in the title", "line = 1"), ("an amount is not in the title", "line = 5"), ("shown as firm but the title says up to", "line = 2"), ("the code is not in the post", "line IN (3)"), ("a word, not a code", "line = 4")), "deals")))
def _(t: Tables):
    c = F.col
    s = job_sale_offer(sale_posts(t)).withColumn("text", F.lit("use PROMO here"))
    s = s.withColumns({"badge": F.when(c("line") == 1, "99% off").otherwise(c("badge")), "offer": F.when(c("line") == 5, "$77 off").otherwise(c("offer")), "pct": F.when(c("line") == 2, c("upto")).otherwise(c("pct")),
                       "upto": F.when(c("line") != 2, c("upto")), "code": F.when(c("line") == 3, "SAVE9").when(c("line") == 4, "PROMO").otherwise("")})
    return summary(q.dq_offer_numbers(s))


@query("dq_end_dates", using("deals", body=summary_sql(some(
    ("the post states an end that is not shown", "line = 1"), ("the post states a different end", "line = 2")), "deals")))
def _(t: Tables):
    c = F.col
    text = F.concat(F.lit("Ends "), F.date_format("valid_to", "MMM d"), F.lit("."))
    ref = F.to_date("valid_from")
    days = F.array_compact(F.array(stated_end(text, ref)["last"], stated_range(text, ref)["last"]))
    sales = t.deals.select("id", "item", F.when(c("line") == 2, F.date_add(F.to_date("valid_to"), 1)).when(c("line") != 1, F.to_date("valid_to")).alias("end_day"), F.lit("the post says").alias("ends_how"))
    return summary(q.dq_end_dates(sales, t.deals.select("id", days.alias("days"))))


@query("dq_recall", using("deals", body=summary_sql(some(("missing with no recorded reason", "line = 3"), ("left out without a good reason", "line = 2")), "deals", unclear="CASE WHEN line = 4 THEN 'the source''s category is overridden on purpose' END")))
def _(t: Tables):
    why = t.deals.where("line IN (1, 2, 4)").select("id", case("line", "item already ended", "no category", "", "other category (home)", "", "", "").alias("reason"))
    return summary(q.dq_recall(t.deals.select("id", "item"), t.deals.where("line >= 5").select("id"), why))


@query("dq_replay", using("deals", body="SELECT diff, fields, count(*) AS n FROM (SELECT 'differs' AS diff, 'offer' AS fields FROM deals WHERE line = 6 UNION ALL SELECT 'missing', '' FROM deals WHERE line = 7) GROUP BY ALL"))
def _(t: Tables):
    s = F.col("size").cast("string")
    want = t.deals.select("id", case("line", F.concat(s, F.lit("% off")), F.concat(F.lit("Up to "), s, F.lit("% off")), F.concat(F.lit("Extra "), s, F.lit("% off")),
                                     F.concat(s, F.lit("–"), (F.col("size") + 20).cast("string"), F.lit("% off")), F.concat(F.lit("$"), s, F.lit(" off $200+")), F.lit("Buy 3 get 1 free"), F.lit("x")).alias("offer"))
    got = job_sale_offer(sale_posts(t)).where("line <> 7").select("id", "offer")
    return q.dq_replay(got, want, "id", ["offer"]).withColumn("fields", F.array_join("fields", ",")).groupBy("diff", "fields").agg(F.count("*").alias("n"))


@query("dq_sales_list", using("deals", body="""
    WITH s AS (SELECT *, row_number() OVER (ORDER BY size DESC, item, line) AS pos FROM deals)
    SELECT 'same wording' AS "check", count(*) FILTER (WHERE item % 10 = 0 AND line = 1) AS problems FROM s UNION ALL SELECT 'similar wording', 0 UNION ALL SELECT 'fresh', CAST(sum(CASE WHEN valid_to < TIMESTAMP '1998-06-01' THEN 1 + (item % 10 = 0 AND line = 1)::INT ELSE 0 END) AS BIGINT) FROM s
    UNION ALL SELECT 'order', count(*) FILTER (WHERE pos % 1000 = 7) FROM s WHERE pos > 1 UNION ALL SELECT 'complete', count(*) FILTER (WHERE line = 7) FROM s"""))
def _(t: Tables):
    # a name of its own for every sale, but for the planted copies; the score falls by one a place, but for the planted steps up
    from .filtering import placed
    deals = placed(t.deals.orderBy(F.desc("size"), "item", "line"), "id", "item", "line", "valid_to")
    c = F.col
    copies = deals.where("item % 10 = 0 AND line = 1").withColumn("place", F.lit(None).cast("bigint"))
    both = deals.unionByName(copies)
    s = both.select("id", c("place").alias("pos"), F.concat(F.lit("k"), c("item") % 1000).alias("store"), F.lit("Store").alias("store_name"), F.lit("20% off").alias("badge"), F.concat(F.lit("zq"), F.md5(F.col("id").cast("string"))).alias("name"),
                    F.when(c("line") == 7, "").otherwise("20% off").alias("offer"), F.when(c("place").isNotNull(), c("valid_to")).otherwise(F.lit("2100-01-01").cast("timestamp")).alias("ends_at"), F.lit(None).cast("timestamp").alias("starts_at"),
                    F.lit("1998-05-30").cast("timestamp").alias("posted_at"), (-c("place") + F.when(c("place") % 1000 == 7, 2).otherwise(0)).cast("double").alias("score"), F.lit("https://x.com/").alias("source_url"), F.array(F.lit("home")).alias("categories"))
    s = s.withColumn("ends_at", F.first("ends_at").over(Window.partitionBy("id").orderBy(F.desc("pos"))))
    return q.dq_sales_list(s, F.lit("1998-06-01").cast("timestamp"))


def page_rows(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", F.concat(F.lit("https://x.com/"), "page_id").alias("url"), "html")


@query("dq_post_page", summary_sql(some(("the price is not on the page", "m = 1"), ("title words missing from the page", "m = 2"), ("the post is marked expired", "m = 3")), "(SELECT page_id, page_id % 5 AS m FROM pages)", "page_id", "CASE WHEN m = 4 THEN 'no page' END"))
def _(t: Tables):
    m = F.col("page_id") % 5
    p = page_rows(t)
    cents = (F.col("page_id") + 0.25)
    body = F.concat("html", F.lit("<p>zinc bolt now $"), F.format_number(cents, 2), F.when(m == 3, "</p>sold out").otherwise("</p>"))
    posts = p.select("page_id", "url", F.when(m == 2, "qqq zzz xxx").otherwise("zinc bolt $3").alias("title"), F.when(m == 1, cents + 700000).otherwise(cents).alias("price"))
    return summary(q.dq_post_page(posts, p.where(m != 4).select("url", body.alias("html"))), "page_id")


@query("dq_store_page", summary_sql("CASE WHEN m = 1 THEN 'neither the ad''s nor the regular price is on the page' ELSE '' END", "(SELECT page_id, page_id % 6 AS m FROM pages)", "page_id",
                                    "CASE m WHEN 2 THEN 'no page' WHEN 3 THEN 'a promotion without a price' WHEN 4 THEN 'the page does not state a price' END"))
def _(t: Tables):
    m = F.col("page_id") % 6
    p = page_rows(t)
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","offers":'), F.when(m == 5, "[").otherwise(""), F.lit('{"price":"'), (F.col("page_id") + 0.5).cast("string"), F.lit('"}'), F.when(m == 5, "]").otherwise(""), F.lit("}</script>"))
    deals = p.select("page_id", "url", F.when(m == 3, None).when(m == 0, F.col("page_id") + 0.5).otherwise(900000.25).alias("price"), F.when(m == 5, F.col("page_id") + 0.5).otherwise(910000.25).alias("regular"))
    return summary(q.dq_store_page(deals, p.where(m != 2).select("url", F.concat("html", F.when(m != 4, ld).otherwise("")).alias("html"))), "page_id")


@query("dq_store_link", using("deals", body=summary_sql(some(("the link goes to a different store", "line IN (1, 2)"), ("another price at the store", "line = 4")), "deals", unclear="CASE WHEN line = 6 THEN 'no link' END")))
def _(t: Tables):
    from .naming import registry
    c, m = F.col, F.col("merchant").cast("string")
    link = case("line", F.concat(F.lit("https://www.acme"), (c("merchant") + 1000000).cast("string"), F.lit(".com/x")), F.lit("https://other.com/dp/1"), F.concat(F.lit("https://shop.acme"), m, F.lit(".com/p/1")),
                F.concat(F.lit("https://acme"), m, F.lit(".com")), F.concat(F.lit("https://acme"), m, F.lit(".com")), F.lit(""), F.concat(F.lit("https://acme"), m, F.lit(".com")))
    d = t.deals.select("id", "item", link.alias("link"), F.concat(F.lit("k"), m).alias("store"), (c("price") + 100).alias("price"), F.lit(1).alias("qty"), F.when(c("line").isin(4, 5), (c("price") + 100) * 1.2).when(c("line") == 3, c("price") + 100).alias("page_price"),
                       F.when(c("line") == 5, F.array(F.lit("promo code"))).otherwise(F.array().cast("array<string>")).alias("conditions"))
    return summary(q.dq_store_link(d, registry(t)))


EVIDENCE = {0: ("list", ""), 1: ("list", "the list page is not for a day this runs on"), 2: ("list", "the list page no longer has an entry for this chain"), 3: ("list", "the chain's entry lacks a claim"),
            4: ("list", "the page says it ended"), 5: ("article", ""), 6: ("article", "the article does not name this place"), 7: ("article", "no passage has all of the claims"), 8: ("official", ""),
            9: ("official", "the page has none of the claims"), 10: ("official", "the claims are on the page but no day this runs on is near them"), 11: ("official", "no passage has all of the claims"), 12: ("official", "")}


@query("dq_evidence_page", summary_sql("CASE " + " ".join(f"WHEN m = {m} THEN '{why.replace(chr(39), chr(39) * 2)}'" for m, (_, why) in EVIDENCE.items()) + " END", "(SELECT page_id, page_id % 15 AS m FROM pages)", "page_id",
                                       "CASE m WHEN 13 THEN 'the offer claims nothing that a page could state' WHEN 14 THEN 'no page' END"))
def _(t: Tables):
    m = F.col("page_id") % 15
    p = page_rows(t)
    far = F.repeat(F.lit("lorem ipsum "), 200)
    title = F.concat(F.lit("<title>Deals for "), F.when(m == 1, "Friday").otherwise("Tuesday"), F.lit("</title>"))
    entry = lambda claim: F.concat(F.lit("<ul><li>"), F.when(m == 2, "Zed's").otherwise("Quark\u2019s Grill"), F.lit(": "), claim, F.lit("</li><li>Zed's: $1 pie</li></ul><h2>Zed</h2><p>BOGO tacos $7.25</p>"))
    listed = F.concat(title, entry(F.concat(F.lit("BOGO tacos at $7.25 every Tuesday"), F.when(m == 4, " through September 30").when(m == 0, " through October 30").otherwise(""), F.lit("."))))
    listed = F.when(m == 3, F.concat(title, entry(F.lit("BOGO tacos at $7.75 every Tuesday.")))).otherwise(listed)
    article = F.concat(F.lit("<p>Best of town: "), F.when(m == 6, "Zed's").otherwise("QUARK'S"), F.lit(" has BOGO tacos "), F.when(m == 7, far).otherwise(""), F.lit(" at $7.25 on Tuesdays.</p>"))
    tail = F.lit(" Also open on Fridays, Saturdays and Sundays.")
    own = F.concat(F.lit("<p>Come by: buy one, get one "), F.when(m == 9, "").when(m == 11, far).otherwise(""), F.when(m == 9, "").otherwise("for $7.25 "), F.when(m.isin(10, 12), far).otherwise(""), F.when(m == 12, "on Tuesday").otherwise(F.concat(F.lit("on Tuesday"), tail)), F.lit("</p>"))
    own = F.when(m == 9, F.lit("<p>Come by on Tuesday.</p>")).otherwise(own)
    kind = F.when(m <= 4, "list").when(m <= 7, "article").otherwise("official")
    html = F.when(m <= 4, listed).when(m <= 7, article).otherwise(own)
    offers = p.select(F.col("page_id").alias("id"), "page_id", "url", kind.alias("kind"), F.lit("Quark's Grill").alias("brand"), F.array(F.lit("tuesday")).alias("day_words"), F.lit(False).alias("bogo"),
                      F.when(m == 13, "Tacos as usual").otherwise("BOGO tacos at $7.25").alias("offer"))
    return summary(ev.dq_evidence_page(offers, p.where(m != 14).select("url", html.alias("html")), F.lit("2026-10-15").cast("date")), "page_id")


@query("dq_sale_page", summary_sql(some(("the page doesn''t name the store", "m = 1"), ("a figure is not on the page", "m = 2"), ("the page doesn''t show the code", "m = 3"), ("shown after its end", "m = 5"), ("the page states an end that is not shown", "m = 6"),
                                        ("the page states a different end", "m IN (5, 7)")), "(SELECT page_id, page_id % 9 AS m FROM pages)", "page_id", "CASE WHEN m = 4 THEN 'no page' END"))
def _(t: Tables):
    m = F.col("page_id") % 9
    p = page_rows(t)
    said = F.concat(F.lit("<b>"), F.when(m == 1, "Zed").otherwise("QUARKMART"), F.lit("</b> "), F.when(m == 2, "20%").otherwise("37%"), F.lit(" off, $1,250 off "), F.when(m == 3, "XX").otherwise("SAVEZZ1"),
                    F.lit(". Ends Oct 20. The outlet ends "), F.when(m == 8, "Oct 26").otherwise("Oct 2"), F.lit("."))
    day = lambda d: F.lit(d).cast("date")
    sales = p.select("page_id", "url", F.array(F.lit("Quarkmart"), F.lit("QM Store")).alias("store_names"), F.lit("37% off + $1,250 off").alias("offer"), F.lit("SAVEZZ1").alias("code"), day("2026-10-05").alias("posted"),
                     F.when(m == 5, day("2026-10-09")).when(m == 7, day("2026-10-22")).when(m == 8, day("2026-10-27")).when(m != 6, day("2026-10-20")).alias("end_day"), F.when(m == 8, "the source's end date").otherwise("the post says").alias("ends_how"))
    return summary(q.dq_sale_page(sales, p.where(m != 4).select("url", F.concat("html", said).alias("html")), day("2026-10-12")), "page_id")
