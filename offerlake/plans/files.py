"""Queries of the readers and sinks: the tables are written out in a source's form, at their full size, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_path
from ..sources import readers as rd
from ..sources import sinks as sk
from .catalog import query
from .inputs import Tables, miles_sql, using
from .wording import usd


def lines(t: Tables, df: DataFrame, text: Column, name: str) -> str:
    path = work_path(t.spark, name)
    df.select(text.alias("value")).write.text(path)
    return path


def json_lines(t: Tables, df: DataFrame, name: str, **fields: Column) -> str:
    return lines(t, df, F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])), name)


def st(**fields: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in fields.items()])


c = F.col


@query("src_ads", using("deals", body="""
    SELECT strftime(ends, '%Y-%m') AS month, count(*) AS n, CAST(sum(item) AS BIGINT) AS checksum FROM (SELECT item, valid_to + INTERVAL 100799 SECOND AS ends FROM deals WHERE line NOT IN (5, 6)) GROUP BY 1"""))
def _(t: Tables):
    d = F.date_format("valid_to", "yyyy-MM-dd")
    flyer = st(id=F.when(c("line") != 5, c("item")), merchant=F.when(c("line") == 4, F.lit("  Acme   Co ")).otherwise("Acme"), valid_from=F.concat(F.date_format("valid_from", "yyyy-MM-dd"), F.lit("T00:00:00-04:00")),
               valid_to=F.concat(d, F.when(c("line") == 6, "T23:59:59").otherwise("T23:59:59-04:00")), categories=F.array(F.lit("All Flyers"), c("category")))
    path = json_lines(t, t.deals, "ads", flyers=F.array(flyer))
    a = rd.src_ads(t.spark, path)
    return a.groupBy(F.date_format("ends", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("id").alias("checksum"))


@query("src_ad_items", using("deals", body="SELECT title AS name, count(*) * 2 AS n, CAST(sum(item) * 2 AS BIGINT) AS checksum FROM deals GROUP BY title"))
def _(t: Tables):
    item = st(id=c("item"), name=c("title"), price=c("price").cast("string"), display_type=F.lit(1), _L1=F.lit("Hardware"))
    i = rd.src_ad_items(t.spark, json_lines(t, t.deals, "items", items=F.array(item, item)))
    return i.groupBy("name").agg(F.count("*").alias("n"), F.sum("id").alias("checksum"))


@query("src_listings", using("deals", body="""
    SELECT via, count(*) AS n, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS cents FROM (SELECT 'this week''s ad' AS via, price FROM deals WHERE line <> 1 UNION ALL SELECT 'online listing', regular FROM deals WHERE line <> 2) GROUP BY via"""))
def _(t: Tables):
    ad = st(id=c("item"), merchant_name=F.lit("Acme"), name=c("title"), current_price=F.when(c("line") != 1, usd("price")).otherwise("$0"))
    online = st(merchant=F.when(c("line") != 2, "Shop").otherwise(""), name=c("title"), current_price=usd("regular"))
    d = rd.src_listings(t.spark, json_lines(t, t.deals, "listings", items=F.array(ad), ecom_items=F.array(online)))
    return d.groupBy("via").agg(F.count("*").alias("n"), F.sum(F.round(c("price") * 100).cast("bigint")).alias("cents"))


def rss(t: Tables, source: str, title: Column, link: Column, text: Column, extra: Column | None = None) -> DataFrame:
    p = t.posts
    esc = lambda x: F.replace(x, F.lit("&"), F.lit("&amp;"))                                       # noqa: E731
    item = F.concat(F.lit("<item><title>"), esc(title), F.lit("</title><link>"), esc(link), F.lit("</link><pubDate>"), F.date_format("posted_at", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate><guid>g"), c("id"), F.lit("</guid><description>"),
                    esc(text), F.lit("</description>"), extra if extra is not None else F.lit(""), F.lit("</item>"))
    # feed files of a bounded number of items, each one well-formed
    path = work_path(t.spark, f"feed-{source}")
    root = '<rss xmlns:dn="https://www.dealnews.com/ns/rss/1.0.htm" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'
    (p.select(F.floor(c("id") / 2000).alias("chunk"), item.alias("item")).groupBy("chunk").agg(F.concat(F.lit(root), F.array_join(F.collect_list("item"), ""), F.lit("</channel></rss>")).alias("value"))
     .write.partitionBy("chunk").text(path))
    return rd.src_feed_posts(t.spark, path, source)


@query("src_feed_posts", """
    SELECT source, count(*) AS n, count(DISTINCT id) AS ids, count(seller) AS sellers, CAST(sum(CAST(round(coalesce(price, 0) * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(sum(CASE WHEN stated THEN 1 ELSE 0 END) AS BIGINT) AS stated FROM (
      SELECT s AS source, event_id AS id, CASE WHEN s IN ('slickdeals', 'hip2save', 'bensbargains', 'dealcatcher', 'dealnews', 'theinventory', '9to5toys') THEN 'x' END AS seller, CASE WHEN s IN ('slickdeals', '9to5toys') THEN NULL ELSE value END AS price,
             s = 'dealnews' AND k % 3 <> 0 AS stated FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, unnest(['dealnews', 'slickdeals', 'hip2save', 'bensbargains', 'theinventory', '9to5toys', 'dealcatcher']) AS s FROM events)) GROUP BY source""")
def _(t: Tables):
    price = F.concat(F.lit("$"), F.format_number("price", 2))
    link = lambda tail: F.concat(F.lit("https://deals.com/"), tail)                                 # noqa: E731
    i = c("id").cast("string")
    # a made-up expiry is 30 days after the post to the second; an editor's end is some hours after
    ends = F.when(c("k") % 3 == 0, c("posted_at") + F.make_dt_interval(F.lit(30))).otherwise(c("posted_at") + F.make_dt_interval(hours=c("k") + 1))
    dn = F.concat(F.lit("<dn:price>"), price, F.lit("</dn:price><dn:retailer>Acme</dn:retailer><dn:dealType>Product</dn:dealType><dn:category>Tools</dn:category><dn:expires>"), F.date_format(ends, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</dn:expires>"))
    was = F.concat(F.lit("$"), F.format_number(c("price") + 5000, 2))
    feeds = [rss(t, "dealnews", F.lit("A bolt & nut"), link(F.concat(F.lit("x/"), F.lpad(i, 8, "0"), F.lit(".html?r=1"))), F.lit("Nice"), dn),
             rss(t, "slickdeals", F.lit("A bolt"), link(F.concat(F.lit("f/"), i, F.lit("-bolt"))), F.lit("Acme has bolts")), rss(t, "hip2save", F.concat(F.lit("Only "), price, F.lit(" on Acme (Reg. $999999)")), link(i), F.lit("x")),
             rss(t, "bensbargains", F.concat(F.lit("A bolt "), price, F.lit(" at Acme")), link(i), F.lit("x")),
             rss(t, "theinventory", F.lit("A bolt $5,000 Off on Amazon"), link(i), F.concat(F.lit("The price of "), price, F.lit(" is cut from the "), was, F.lit(" regular price."))),
             rss(t, "9to5toys", F.concat(F.lit("Bolts via Amazon "), price, F.lit(" (40% off)")), link(i), F.lit("x")), rss(t, "dealcatcher", F.concat(F.lit("Acme - A bolt "), price), link(F.concat(F.lit("deals/tools/"), i)), F.lit("x"))]
    all_ = feeds[0]
    for f in feeds[1:]:
        all_ = all_.unionByName(f)
    return all_.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count(F.nullif("seller", F.lit(""))).alias("sellers"),
                                      F.sum(F.round(F.coalesce("price", F.lit(0)) * 100).cast("bigint")).alias("cents"), F.sum(c("expires_stated").cast("bigint")).alias("stated"))


@query("src_shop_products", using("deals", body="""
    SELECT options, title, words, count(*) AS n, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(sum(CAST(round(regular * 100) AS BIGINT)) AS BIGINT) AS regulars FROM (
      SELECT line % 2 = 0 AS options, title || ' & more' AS title, category || ' ' || brand || ' new' AS words, price, regular FROM deals WHERE regular > price) GROUP BY ALL"""))
def _(t: Tables):
    v = lambda p, w, ok=True: st(price=p.cast("string"), compare_at_price=w.cast("string"), available=F.lit(ok))                  # noqa: E731
    sale, dear, gone = v(c("price"), c("regular")), v(c("regular"), F.lit(None)), v(c("price") / 2, c("regular"), False)
    variants = F.when(c("line") % 2 == 0, F.array(dear, sale, gone)).otherwise(F.array(sale))

    def shop(tags: Column) -> Column:
        product = st(title=F.concat("title", F.lit(" &amp; more")), handle=F.replace("title", F.lit(" "), F.lit("-")), product_type=c("category"), tags=tags, variants=variants)
        return F.to_json(st(host=F.lit("acme.com"), products=F.array(product)))
    # tags come as a list or as one text
    text = F.when(c("line") % 3 == 0, shop(F.concat("brand", F.lit(", new")))).otherwise(shop(F.array("brand", F.lit("new"))))
    d = rd.src_shop_products(t.spark, lines(t, t.deals, text, "shop"))
    return d.groupBy("options", "title", "words").agg(F.count("*").alias("n"), F.sum(F.round(c("price") * 100).cast("bigint")).alias("cents"), F.sum(F.round(c("regular") * 100).cast("bigint")).alias("regulars"))


@query("src_woo_products", using("deals", body="""
    SELECT title, words, count(*) AS n, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS cents FROM (SELECT title || ' & co' AS title, brand || ' ' || category AS words, price FROM deals WHERE regular > price AND line <> 1) GROUP BY ALL"""))
def _(t: Tables):
    cents = lambda x: F.round(c(x) * 100).cast("bigint").cast("string")                              # noqa: E731
    prices = st(sale_price=cents("price"), price=cents("regular"), regular_price=cents("regular"), currency_code=F.when(c("line") == 1, "EUR").otherwise("USD"), currency_minor_unit=F.lit(2))
    product = st(name=F.concat(F.lit("<b>"), "title", F.lit("</b> &#38; co")), permalink=F.lit("https://acme.com/p"), prices=prices, categories=F.array(st(name=c("brand")), st(name=c("category"))))
    d = rd.src_woo_products(t.spark, json_lines(t, t.deals, "woo", host=F.lit("acme.com"), items=F.array(product)))
    return d.groupBy("title", "words").agg(F.count("*").alias("n"), F.sum(F.round(c("price") * 100).cast("bigint")).alias("cents"))


@query("src_places", using("cities", body="""
    SELECT chain, kind, tagged, count(*) AS n, CAST(sum(id) AS BIGINT) AS checksum FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 'brand' || nation WHEN id % 4 = 1 THEN 'shop' || nation WHEN id % 4 = 2 THEN 'shop' || nation END AS chain,
      CASE WHEN id % 2 = 0 THEN 'restaurant' ELSE 'store' END AS kind, id % 4 = 0 AS tagged FROM cities WHERE id % 4 <> 3 AND id % 7 <> 0) GROUP BY ALL"""))
def _(t: Tables):
    n, m = c("nation").cast("string"), c("id") % 4
    tags = F.map_from_arrays(F.array(*[F.lit(x) for x in ("brand:wikidata", "brand", "name", "amenity", "shop")]),
                             F.array(F.when(m == 0, F.concat(F.lit("Q"), n)).otherwise(""), F.when(m == 1, F.concat(F.lit("Shop & Co "), n)).otherwise("x"), F.when(m == 2, F.concat(F.lit("SHOP and co "), n)).otherwise("y"),
                                     F.when(c("id") % 2 == 0, "cafe").otherwise(""), F.when(c("id") % 2 == 1, "hardware").otherwise("")))
    pois = t.cities.select(c("id").alias("ref"), F.when(c("id") % 7 != 0, c("lat")).alias("lat"), "lon", tags.alias("tags"))
    nat = t.read("nation").select(c("n_nationkey").cast("string").alias("k"))
    brands = nat.select(F.concat(F.lit("Q"), "k").alias("brand_id"), F.concat(F.lit("brand"), "k").alias("chain"))
    merchants = nat.select(F.concat(F.lit("Shop & Co "), "k").alias("name"), F.concat(F.lit("shop"), "k").alias("chain"))
    return rd.src_places(pois, brands, merchants).groupBy("chain", "kind", "tagged").agg(F.count("*").alias("n"), F.sum("ref").alias("checksum"))


@query("src_cities", using("cities", "places", body=f"""
    WITH z AS (SELECT 'z' || merchant AS zip, lat, lon, merchant FROM places), near AS (SELECT id, zip, merchant FROM (SELECT c.id, p.zip, p.merchant, row_number() OVER (PARTITION BY c.id ORDER BY {miles_sql('c', 'p')}, p.zip) AS r FROM cities c, z p) WHERE r = 1)
    SELECT c.id AS geo, CASE WHEN c.id % 3 = 2 THEN c.population WHEN c.id % 5 = 0 THEN c.population ELSE 300 END AS population, near.zip, CASE WHEN c.id % 3 <> 2 AND c.id % 5 <> 0 THEN 'c' || c.id % 9 ELSE 'k' || near.merchant % 4 END AS county
    FROM cities c JOIN near USING (id) WHERE c.id % 3 <> 2 OR c.population >= 1000"""))
def _(t: Tables):
    place = F.when(c("id") < 100000, F.lpad(c("id").cast("string"), 5, "0")).otherwise(c("id").cast("string"))
    geo = F.concat(F.lit("48"), place)
    p = t.cities.select(geo.alias("geoid"), "name", F.when(c("id") % 3 == 2, "cdp").otherwise("city").alias("kind"), "lat", "lon")
    pep = t.cities.where("id % 3 <> 2 AND id % 5 <> 0").select(place.alias("place"), F.explode(F.array(st(county=F.lit("c99"), population=F.lit(100).cast("bigint")), st(county=F.concat(F.lit("c"), c("id") % 9), population=F.lit(200).cast("bigint")))).alias("x")).select("place", "x.*")
    acs = t.cities.select(place.alias("place"), "population")
    z = t.places.select(F.concat(F.lit("z"), "merchant").alias("zip"), "lat", "lon", "merchant")
    zc = z.select("zip", F.explode(F.array(st(county=F.lit("small"), land=F.lit(5)), st(county=F.concat(F.lit("k"), c("merchant") % 4), land=F.lit(50)))).alias("x")).select("zip", "x.*")
    d = rd.src_cities(p, pep, acs, z, zc)
    return d.select(F.expr("substring(geoid, 3)").cast("bigint").alias("geo"), "population", "zip", "county")


@query("src_dims", using("deals", body="SELECT m.name, count(*) AS n FROM deals JOIN (SELECT s_suppkey, s_name AS name FROM supplier WHERE s_suppkey % 3 = 0) m ON merchant = s_suppkey GROUP BY m.name"))
def _(t: Tables):
    path = work_path(t.spark, "dims")
    t.read("supplier").where("s_suppkey % 3 = 0").select(c("s_suppkey").alias("key"), c("s_name").alias("name"), F.array("s_name").alias("aliases")).write.json(path)
    d = t.spark.read.schema("key bigint, name string, aliases array<string>").json(path)
    return t.deals.join(d, c("merchant") == c("key")).groupBy("name").agg(F.count("*").alias("n"))


@query("src_feed_manifest", """
    SELECT source, count(*) AS n, min(url) AS first FROM (SELECT 'hip2save' AS source, 'https://h/' || t || s AS url FROM (SELECT DISTINCT p_type AS t FROM part WHERE p_type <> 'PROMO'), (SELECT unnest(['/a', '/b']) AS s)
      UNION ALL SELECT 'dealnews', 'https://feeds/s' || s_suppkey || '/?rss=1' FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'slickdeals', 'https://sd/rss') GROUP BY source""")
def _(t: Tables):
    cats = t.read("part").select(c("p_type").alias("category"), (c("p_type") != "PROMO").alias("online")).distinct()
    feeds = cats.select(F.lit("hip2save").alias("source"), "category", F.array(F.concat("category", F.lit("/a")), F.concat("category", F.lit("/b"))).alias("slugs"), F.lit("https://h/").alias("base"))
    stores = t.read("supplier").select(c("s_name").alias("store"), F.when(c("s_suppkey") % 2 == 0, c("s_suppkey").cast("string")).otherwise("").alias("path"))
    general = t.spark.createDataFrame([("slickdeals", "slickdeals frontpage", "https://sd/rss")], "source string, name string, url string")
    return rd.src_feed_manifest(cats, feeds, stores, general).groupBy("source").agg(F.count("*").alias("n"), F.min("url").alias("first"))


@query("src_brand_index", """
    SELECT 'Q' || p_partkey AS brand_id, p_brand || ' Inc' AS name, CASE WHEN p_brand || ' Inc' < p_name THEN p_brand || ' Inc,' || p_name ELSE p_name || ',' || p_brand || ' Inc' END AS aliases FROM part WHERE p_partkey % 4 IN (0, 1) AND p_size % 2 = 0""")
def _(t: Tables):
    item = st(displayName=c("p_name"), tags=F.create_map(F.lit("brand:wikidata"), F.concat(F.lit("Q"), "p_partkey"), F.lit("brand"), F.concat("p_brand", F.lit(" Inc"))),
              locationSet=st(include=F.array(F.when(c("p_partkey") % 4 == 0, "001").when(c("p_partkey") % 4 == 1, "US-tx.geojson").otherwise("de"))))
    path = json_lines(t, t.read("part"), "index", path=F.when(c("p_size") % 2 == 0, "brands/amenity/cafe").otherwise("brands/office/x"), items=F.array(item))
    return rd.src_brand_index(t.spark, path, ["brands/amenity/"]).select("brand_id", "name", F.array_join("aliases", ",").alias("aliases"))


@query("src_offer_registry", using("deals", body="""
    SELECT reason, weekdays, monthly, a, count(*) AS n FROM (SELECT CASE line WHEN 1 THEN 'needs a brand and an offer' WHEN 2 THEN 'not a day: someday' WHEN 3 THEN 'needs the days it runs on' WHEN 4 THEN 'dates must look like 2026-12-31'
      WHEN 5 THEN CASE WHEN valid_to < TIMESTAMP '1998-06-01' THEN 'past its stated end date' END END AS reason, CASE line WHEN 2 THEN '' WHEN 3 THEN '' WHEN 6 THEN '5,6' WHEN 7 THEN '' ELSE '0,1,2,3,4' END AS weekdays,
      CASE line WHEN 7 THEN CASE WHEN size % 2 = 0 THEN '1:1' ELSE 'd:7' END ELSE '' END AS monthly, CASE line WHEN 6 THEN 17 * 3600 END AS a FROM deals) GROUP BY ALL"""))
def _(t: Tables):
    days = (F.when(c("line") == 2, F.array(F.lit("someday"))).when(c("line") == 3, F.array().cast("array<string>")).when(c("line") == 6, F.array(F.lit("Weekend")))
            .when(c("line") == 7, F.array(F.when(c("size") % 2 == 0, "First Tuesday").otherwise("7th"))).otherwise(F.array(F.lit("weekdays"), F.lit("mon"))))
    path = json_lines(t, t.deals, "registry", id=c("id"), brand=F.when(c("line") == 1, "").otherwise("Acme Grill"), offer=F.lit("Half off wings"), days=days, time=F.when(c("line") == 6, "after 5 pm").otherwise(""),
                      until=F.when(c("line") == 4, "12/31").when(c("line") == 5, F.date_format("valid_to", "yyyy-MM-dd")))
    chains = t.spark.createDataFrame([("Acme Grill", "c1", 9)], "alias string, chain string, places bigint")
    d = rd.src_offer_registry(t.spark, path, F.lit("1998-06-01").cast("date"), chains)
    return d.select("reason", F.array_join("weekdays", ",").alias("weekdays"), "monthly", F.get("hours.windows", 0)["a"].alias("a")).groupBy("reason", "weekdays", "monthly", "a").agg(F.count("*").alias("n"))


# The references that the pages hold and that the query plants, by name; "&amp" may lack its semicolon, and is decoded last.
SHOWN = "t"
for _from, _to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#53;", "5"), ("&copy;", "©"), ("&middot;", "·"), ("&rsquo;", "’")):
    SHOWN = f"replace({SHOWN}, '{_from}', '{_to}')"


@query("src_html_pages", r"""
    WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html || 'Fish &amp; chips&rsquo; &#53;', '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
             '(?is)<(noscript|svg)[^>]*>.*?</(noscript|svg)>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
    shown AS (SELECT page_id, regexp_replace(SHOWN, '&amp;?', '&', 'g') AS t FROM bare)
    SELECT page_id, md5(trim(regexp_replace(regexp_replace(translate(translate(t, '’‘“”', '''''""'), '–—−®™', '---'), '[ \t\n\x0b\f\r]+', ' ', 'g'), '[ \t\n\x0b\f\r]+([.,;:!?])', '\1', 'g'))) AS visible,
           'Half price "tacos" with all the trimmings you like every Tuesday, for lunch and for dinner, salsa & chips ' || page_id AS in_scripts FROM shown""".replace("SHOWN", SHOWN))
def _(t: Tables):
    script = F.concat(F.lit(r'<script>{"id":"abc","text":"Half price \"tacos\" with all the trimmings you like\u0020every Tuesday, for lunch and for dinner, salsa &amp; chips '), "page_id", F.lit('","js":"function() { return 1; }"}</script>'))
    d = rd.src_html_pages(t.read("pages").withColumn("html", F.concat("html", F.lit("Fish &amp; chips&rsquo; &#53;"), script)))
    return d.select("page_id", F.md5("visible").alias("visible"), "in_scripts")


@query("src_roundup_lists", """
    SELECT section, day, brand, text, context, link, count(*) AS n FROM (SELECT 'limited' AS section, (page_id % 5)::INTEGER AS day, 'Chain & Co ' || page_id % 10 AS brand, 'Buy one get one free wings today' AS text, '' AS context, 'https://chain.com/a' AS link FROM pages
      UNION ALL SELECT 'every', (page_id % 5)::INTEGER, 'Grill ' || page_id % 10, 'kids eat free with an adult meal', '', '' FROM pages
      UNION ALL SELECT 'weekend', unnest([5, 6]), 'Diner', 'half price brunch for the table', '', '' FROM pages UNION ALL SELECT 'weekend', 6, 'Bistro', 'half price brunch on Sundays only', '', '' FROM pages
      UNION ALL SELECT 'every', (page_id % 5)::INTEGER, 'Pub ' || page_id % 10, 'Get wings for $8 on ' || dayname || '. Dine-in only. You must mention the deal.', 'The pub has many deals.', 'https://pub.com' FROM (SELECT page_id, (['Mondays', 'Tuesdays', 'Wednesdays', 'Thursdays', 'Fridays'])[page_id % 5 + 1] AS dayname FROM pages)
      UNION ALL SELECT 'every', (page_id % 5)::INTEGER, 'Bar', 'Half price pies every ' || dayname, 'Only for members:', '' FROM (SELECT page_id, (['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday'])[page_id % 5 + 1] AS dayname FROM pages)) GROUP BY ALL""")
def _(t: Tables):
    k, day = (c("page_id") % 10).cast("string"), (c("page_id") % 5)
    name = lambda d: F.element_at(F.array(*[F.lit(x) for x in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")]), (d % 5 + 1).cast("int"))
    items = F.concat("html", F.lit("<h2>Limited-Time Food Deals</h2><ul><li><b>Chain &amp; Co "), k, F.lit('</b> (CH): <a href="https://www.facebook.com/c"></a><a href="https://chain.com/a"></a>Buy one get one free wings today</li><li>No colon here at all</li><li>Oct 12: a date is no chain, so it goes</li></ul><h3>Every-Monday Deals</h3><li>Grill '), k,
                     F.lit(": kids eat free with an adult meal</li><h2>Weekend Food Deals</h2><li>Diner: half price brunch for the table</li><li>Bistro: half price brunch on Sundays only</li><h2>More reading</h2><li>Else: this is not in a section at all</li>"))
    sections = F.concat("html", F.lit("<h2>Pub "), k, F.lit('</h2><p>The pub has many deals. Get wings for $8 on '), name(day), F.lit("s. Dine-in only. Click here now. You must mention the deal. "), name(day + 1), F.lit('s bring tacos. Dine-in only. <a href="https://pub.com">Pub</a></p>'
                        "<p>It also has beer. Good at the bar.</p><h2>Bar</h2><p>Only for members:</p><ul><li>Half price pies every "), name(day), F.lit("</li><li>Free fries every "), name(day + 1), F.lit("</li></ul><h2>Related reading?</h2><p>Every "), name(day), F.lit(" counts.</p>"))
    page = t.read("pages").select("url", day.alias("day"), items.alias("items"), sections.alias("sections"))
    both = page.select("url", "day", F.lit("items").alias("form"), c("items").alias("html")).unionByName(page.select("url", "day", F.lit("sections").alias("form"), c("sections").alias("html")))
    return rd.src_roundup_lists(both).groupBy("section", "day", "brand", "text", "context", "link").agg(F.count("*").alias("n"))


# --- sinks ---

@query("snk_verdicts", using("verdicts", body="""
    SELECT run, category, v AS verdict, count(*) AS n FROM (SELECT run, category, CASE WHEN length % 3 = 0 THEN 'pass' ELSE verdict END AS v FROM verdicts) GROUP BY ALL"""))
def _(t: Tables):
    new = t.verdicts.where("length % 3 = 0").withColumn("verdict", F.lit("pass"))
    path = work_path(t.spark, "verdicts")
    sk.snk_verdicts(t.verdicts, new).write.parquet(path)
    return t.spark.read.parquet(path).groupBy("run", "category", "verdict").agg(F.count("*").alias("n"))


@query("snk_snapshot", using("scored", body="SELECT category, basis, count(*) AS n, count(hedge) AS hedged, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS cents FROM (SELECT category, basis, nullif(hedge, '') AS hedge, price FROM scored) GROUP BY ALL"))
def _(t: Tables):
    path = work_path(t.spark, "snapshot")
    sk.snk_snapshot(t.scored.select("id", "category", "basis", "hedge", "price", "score"), path, ["category"], {"hedge": ""})
    d = t.spark.read.schema("id string, basis string, hedge string, price double, score double, category string").json(path)
    return d.groupBy("category", "basis").agg(F.count("*").alias("n"), F.count("hedge").alias("hedged"), F.sum(F.round(c("price") * 100).cast("bigint")).alias("cents"))


@query("snk_price_obs", using("price_points", body="SELECT day, product, count(*) AS n FROM (SELECT product, unnest(['2024-01-01', '2024-01-02']) AS day FROM price_points) GROUP BY ALL"))
def _(t: Tables):
    path = work_path(t.spark, "prices")
    p = t.price_points.select("product", "site", "price")
    for day in ("2024-01-01", "2024-01-02"):
        sk.snk_price_obs(p, path, F.lit(f"{day} 08:00:00").cast("timestamp"))
    return t.spark.read.parquet(path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "product").agg(F.count("*").alias("n"))


@query("snk_label_upsert", using("posts", body="""
    WITH stored AS (SELECT seller AS key, max(posted_at) AS seen FROM posts WHERE k < 60 AND posted_at < TIMESTAMP '2024-01-15' GROUP BY 1), new AS (SELECT seller * 2 AS key, max(posted_at) AS seen FROM posts WHERE posted_at >= TIMESTAMP '2024-01-15' GROUP BY 1)
    SELECT * FROM (SELECT count(*) AS kept FROM (SELECT key, coalesce(n.seen, s.seen) AS seen FROM stored s FULL JOIN new n USING (key)) WHERE seen >= TIMESTAMP '2024-01-31' - INTERVAL 17 DAY), (SELECT count(*) AS new FROM new WHERE key NOT IN (SELECT key FROM stored))"""))
def _(t: Tables):
    none = F.array().cast("array<string>")
    ex = lambda df, k: df.groupBy(k.alias("key")).agg(F.max("posted_at").alias("seen_at")).select("key", F.lit("s").alias("source"), none.alias("words"), none.alias("categories"), "seen_at")      # noqa: E731
    stored = ex(t.posts.where("k < 60 AND posted_at < TIMESTAMP '2024-01-15'"), c("seller"))
    new = ex(t.posts.where("posted_at >= TIMESTAMP '2024-01-15'"), c("seller") * 2)
    after, added = sk.snk_label_upsert(stored, new, F.lit("2024-01-31").cast("timestamp"), 17)
    return after.agg(F.count("*").alias("kept")).crossJoin(added)                  # one row each


@query("snk_read_log", using("reads", body="""
    WITH r AS (SELECT key, checked_at, found, row_number() OVER (PARTITION BY key ORDER BY checked_at) AS i FROM (SELECT key, checked_at, bool_or(found) AS found FROM reads WHERE found IS NOT NULL AND checked_at >= TIMESTAMP '2024-01-15' GROUP BY ALL)),
    s AS (SELECT key, max(checked_at) AS at, arg_max(found, checked_at) AS found FROM reads WHERE found IS NOT NULL AND checked_at < TIMESTAMP '2024-01-15' GROUP BY key),
    walk AS (SELECT k.key, 0::BIGINT AS i, s.at, s.found, false AS kept FROM (SELECT DISTINCT key FROM r) k LEFT JOIN s USING (key)
      UNION ALL SELECT w.key, r.i, CASE WHEN w.found = r.found AND epoch_us(r.checked_at) - epoch_us(w.at) < 36000000000 THEN w.at ELSE r.checked_at END, r.found,
                       NOT coalesce(w.found = r.found AND epoch_us(r.checked_at) - epoch_us(w.at) < 36000000000, false) FROM walk w JOIN r ON r.key = w.key AND r.i = w.i + 1)
    SELECT key, count(*) AS kept FROM walk WHERE kept GROUP BY key"""))
def _(t: Tables):
    r = t.reads.where("found IS NOT NULL").select("key", "checked_at", "found")
    return sk.snk_read_log(r.where("checked_at < TIMESTAMP '2024-01-15'"), r.where("checked_at >= TIMESTAMP '2024-01-15'"), 36000).groupBy("key").agg(F.count("*").alias("kept"))
