"""Readers of the sources' files into typed tables. Every field is read with a schema and defensively: what is missing or
odd is null, and rows that lack what makes them one are dropped or given a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fn_money, fn_norm
from ..functions.amounts import bind, number, rounded
from ..functions.entities import fn_unescape, fn_unescape_string
from ..functions.text import fn_clean, fn_tidy
from ..functions.times import instant
from ..operators.calendar import time_windows, weekdays_in
from ..operators.terms import job_post_seller, job_price_pair, plain_page, title_price
from ..operators.wordwork import got, got_number, says
from ..rules import standing as S

# --- weekly ads ---
ADS = "flyers array<struct<id: bigint, merchant: string, merchant_id: bigint, valid_from: string, valid_to: string, categories: array<string>, postal_code: string>>"
AD_ITEMS = ("items array<struct<id: bigint, flyer_id: bigint, name: string, brand: string, price: string, current_price: string, original_price: string, dollars_off: double, percent_off: double, "
            "discount: double, pre_price_text: string, post_price_text: string, price_text: string, sale_story: string, description: string, disclaimer_text: string, in_store_only: boolean, "
            "display_type: int, valid_from: string, valid_to: string, _L1: string, _L2: string, merchant_name: string>>")


def src_ads(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Ads of an answer, one row each; rows without id, merchant or dates that can be placed are dropped."""
    f = spark.read.schema(ADS).json(paths).select(F.explode("flyers").alias("f")).select("f.*")
    df = f.withColumns({"merchant": fn_clean(F.col("merchant")), "starts": instant(F.col("valid_from")), "ends": instant(F.col("valid_to")),
                        "categories": F.filter(F.coalesce("categories", F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != "All Flyers"))})
    return df.where("id IS NOT NULL AND merchant <> '' AND starts IS NOT NULL AND ends IS NOT NULL")


def src_ad_items(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.schema(AD_ITEMS).json(paths).select(F.explode("items").alias("i")).select("i.*")


def src_listings(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Other sites' listings in a search answer: ad items and online ones, in one schema."""
    schema = ("items array<struct<id: bigint, merchant_name: string, name: string, current_price: string, original_price: string>>, "
              "ecom_items array<struct<merchant: string, name: string, current_price: string, original_price: string>>")
    raw = spark.read.schema(schema).json(paths)
    one = lambda site, via: [fn_clean(F.col(site)).alias("site"), fn_clean(F.col("i.name")).alias("title"), fn_money(F.col("i.current_price")).alias("price"),
                             fn_money(F.col("i.original_price")).alias("regular"), F.lit(via).alias("via")]
    ads = raw.select(F.explode("items").alias("i")).select(*one("i.merchant_name", "this week's ad"))
    online = raw.select(F.explode("ecom_items").alias("i")).select(*one("i.merchant", "online listing"))
    return ads.unionByName(online).where("price IS NOT NULL AND site <> '' AND title <> ''")


# --- feeds ---
ITEM = ("title string, link string, pubDate string, description string, guid string, category array<string>, `content:encoded` string, `dn:expires` string, `dn:price` string, `dn:retailer` string, "
        "`dn:dealType` string, `dn:category` string")


ENTRY = "title string, link array<struct<_href: string, _rel: string>>, published string, updated string, summary string, id string, category array<struct<_term: string>>, content string"


def src_feed_posts(spark: SparkSession, paths: str | Sequence[str], source: str) -> DataFrame:
    """A deal site's feed items, RSS or Atom, as posts of one schema. Each site says the price, the seller and the saving its own way."""
    c = F.col
    raw = spark.read.format("xml").schema(ITEM).option("rowTag", "item").load(paths)
    entry = spark.read.format("xml").schema(ENTRY).option("rowTag", "entry").load(paths)
    href = F.coalesce(F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), 0)["_href"], F.get("link", 0)["_href"])
    raw = raw.unionByName(entry.select("title", href.alias("link"), F.coalesce("published", "updated").alias("pubDate"), c("summary").alias("description"), c("id").alias("guid"),
                                       F.transform("category", lambda x: x["_term"]).alias("category"), c("content").alias("content:encoded")), allowMissingColumns=True)
    text = fn_clean(plain_page(F.coalesce(F.nullif(c("`content:encoded`"), F.lit("")), c("description"), F.lit(""))))
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), instant(c("pubDate")))
    none, nul = F.lit(None).cast("string"), F.lit(None).cast("double")
    p = raw.select(F.lit(source).alias("source"), fn_clean(fn_unescape(c("title"))).alias("title"), fn_clean(c("link")).alias("url"), text.alias("text"), when.alias("posted_at"), fn_clean(c("guid")).alias("guid"),
                   c("category").alias("cats"), *[c(f"`dn:{x}`").alias(f"_{x}") for x in ("expires", "price", "retailer", "dealType", "category")],
                   F.regexp_extract_all(F.coalesce(c("`content:encoded`"), c("description"), F.lit("")), F.lit(r"href=[\"'](https?://[^\"']+)"), F.lit(1)).alias("_links"))
    p = p.withColumn("links", F.transform("_links", fn_unescape)).drop("_links")
    last = F.regexp_extract(F.regexp_replace("url", r"/+$", ""), r"([^/]+)$", 1)
    price, ref, pct, seller, key, kind, cat, exp = nul, nul, nul, F.lit(""), last, F.lit(""), F.array_join(F.slice(F.coalesce("cats", F.array().cast("array<string>")), 1, 4), ", "), none
    if source == "dealnews":
        p = p.withColumn("url", F.split_part("url", F.lit("?"), F.lit(1)))
        key = F.coalesce(F.nullif(F.regexp_extract("url", r"/(\d{5,})(?:\.html)?$", 1), F.lit("")), c("url"))
        price, seller, kind, cat, exp = fn_money(c("_price")), fn_clean(c("_retailer")), F.lower(fn_clean(c("_dealType"))), fn_clean(c("_category")), c("_expires")
    elif source == "slickdeals":
        p = job_post_seller(p.withColumns({"url": F.split_part("url", F.lit("?"), F.lit(1)), "text": F.regexp_replace("text", r"^Thumb Score: [+-]?\d+\s*", "")}))
        key, seller = F.coalesce(F.nullif(F.regexp_extract("url", r"/f/(\d+)", 1), F.lit("")), c("url")), c("seller_said")
    elif source == "hip2save":
        price, ref = fn_money(got(c("title"), r"(?:just|only|as low as|for|now)\s+\$\s?(\d[\d,]*(?:\.\d{1,2})?)")), fn_money(got(c("title"), r"\((?:reg(?:ularly)?\.?|was)\s*\$\s?(\d[\d,]*(?:\.\d{1,2})?)\)"))
        seller = F.coalesce(F.trim(got(c("title"), r"\b(?:on|at|from|@)\s+([A-Z][\w&'.\- ]{1,30}?)(?:\.com)?(?:\s*\(|\s*[|!]|$|\s+\+|\s+-)")), F.lit(""))
    elif source == "bensbargains":
        rx = r"\$\s?(\d[\d,]*(?:\.\d{1,2})?)\s+at\s+(.+)$"
        price, seller = fn_money(F.nullif(F.regexp_extract("title", rx, 1), F.lit(""))), fn_clean(F.regexp_extract("title", rx, 2))
    elif source == "theinventory":
        p = job_price_pair(p)
        now, at = r"(?:is|are) (?:now |down to |on sale for )?\$\s?(\d[\d,]*(?:\.\d{1,2})?)\s*\((\d{1,2})% off\)", r"(\d{1,2})% off at \$\s?(\d[\d,]*(?:\.\d{1,2})?)"
        both = F.concat_ws(" ", "title", "text")
        priced = F.coalesce(got(c("text"), now), got(both, at, 2))
        own = priced.isNull() & title_price(c("title")).isNull()
        price, ref = F.when(priced.isNotNull(), fn_money(priced)).when(own, c("pair_price")), F.when(own, c("pair_reference"))
        pct = F.when(~own | c("pair_reference").isNull(), F.coalesce(got_number(c("text"), now, 2), got_number(both, at, 1), got_number(c("title"), r"\((\d{1,2})% off\)")))
        seller = F.regexp_extract(both, r"\b(?:on|at) (Amazon|Walmart|Target|Best Buy|Nordstrom|Macy's|Kohl's|Zappos|REI|Wayfair)\b", 1)
        key = F.coalesce(F.nullif(c("guid"), F.lit("")), c("url"))
    elif source == "9to5toys":
        off = fn_money(got(c("title"), r"\(\$\s?(\d[\d,]*(?:\.\d{1,2})?)\s+off\)"))
        ref = F.coalesce(fn_money(got(c("title"), r"\((?:reg(?:ularly)?\.?|was)\s*\$\s?(\d[\d,]*(?:\.\d{1,2})?)\)")), rounded(title_price(c("title")) + off, 2))
        pct = F.when(ref.isNull(), got_number(c("title"), r"\((?:save\s+)?(\d{1,2})\s?%(?:\s+off)?\)"))
        stores = "Amazon|Walmart|Target|Best Buy|Woot|Newegg|B&H|Home Depot|Lowe's|eBay"
        seller = F.coalesce(*[F.nullif(F.regexp_extract(x, rx, 1), F.lit("")) for x, rx in (
            (c("title"), rf"\b(?:via|at|on) ({stores})\b"), (c("text"), rf"\b({stores}|Wellbots|Anker)(?:'s official storefront)? (?:is (?:now )?offering|now offers|has|is now selling)\b"), (c("text"), rf"\b(?:via|at|on) ({stores})\b"))], F.lit(""))
    elif source == "dealcatcher":
        rx = r"^(.{2,40}?) - (.+?)\s+\$\s?(\d[\d,]*(?:\.\d{1,2})?)\s*$"
        price, seller = fn_money(F.nullif(F.regexp_extract("title", rx, 3), F.lit(""))), F.regexp_extract("title", rx, 1)
        cat = F.replace(F.regexp_extract("url", r"/deals/([\w-]+)/", 1), F.lit("-"), F.lit(" "))
        p = p.withColumns({"_seller": seller, "_p": price, "title": F.when(c("title").rlike(rx), F.regexp_extract("title", rx, 2)).otherwise(c("title"))})
        price, seller = c("_p"), c("_seller")
    else:
        raise ValueError(f"unknown source {source}")
    ends = F.coalesce(instant(exp), F.try_to_timestamp(exp))
    took = (F.unix_micros(ends) - F.unix_micros("posted_at")) / 1e6
    made_up = F.exists(F.array(*[F.lit(float(n * 86400 + s)) for n in (7, 30, 90) for s in (0, 3600, -3600)]), lambda s: F.abs(took - s) < 120)
    df = p.withColumns({"id": F.concat(F.lit(source + ":"), key), "price": price, "reference": ref, "pct_stated": pct, "seller": seller, "deal_type": kind, "category": cat, "expires_at": ends})
    stated = ends.isNotNull() & F.when(c("posted_at").isNull(), F.substring(exp, 12, 8) == "23:59:00").otherwise(~made_up)
    df = df.withColumn("expires_stated", F.coalesce(stated, F.lit(False)) if source == "dealnews" else F.lit(False))
    return df.select("source", "id", "url", "title", "text", "posted_at", "expires_at", "expires_stated", "price", "reference", "pct_stated", "seller", "deal_type", "category", "links")


def src_feed_manifest(categories: DataFrame, feeds: DataFrame, stores: DataFrame, general: DataFrame) -> DataFrame:
    """The feeds to read: each online category's at each source, each store's own, the general ones. Needs categories(category,
    online), feeds(source, category, slugs, base), stores(store, path), general(source, name, url)."""
    f = (feeds.join(categories.where("online"), "category").select("source", "base", "category", F.explode("slugs").alias("slug"))
         .select("source", F.concat_ws(" ", "source", "slug").alias("name"), F.concat("base", "slug").alias("url"), F.array("category").alias("categories")))
    none = F.array().cast("array<string>")
    s = stores.where("path <> ''").select(F.lit("dealnews").alias("source"), F.concat(F.lit("dealnews store "), "store").alias("name"), F.concat(F.lit("https://feeds/s"), "path", F.lit("/?rss=1")).alias("url"), none.alias("categories"))
    return f.unionByName(s).unionByName(general.withColumn("categories", none))


# --- shops ---
SHOP = "host string, products array<struct<title: string, handle: string, product_type: string, tags: string, variants: array<struct<price: string, compare_at_price: string, available: boolean>>>>"
WOO = ("host string, items array<struct<name: string, permalink: string, prices: struct<price: string, regular_price: string, sale_price: string, currency_code: string, currency_minor_unit: int>, "
       "categories: array<struct<name: string>>>>")


def src_shop_products(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Products on sale at shops whose pages list variants: the variant with the biggest saving, and whether others cost more."""
    p = spark.read.schema(SHOP).json(paths).select("host", F.explode("products").alias("p")).select("host", "p.*")
    v = F.transform("variants", lambda x: F.struct(F.nullif(number(x["price"]), F.lit(0.0)).alias("price"), F.nullif(number(x["compare_at_price"]), F.lit(0.0)).alias("was"), F.coalesce(x["available"], F.lit(True)).alias("ok")))
    sale = F.filter(v, lambda x: (x["was"] > x["price"]) & x["ok"])
    best = F.array_min(F.transform("sale", lambda x: F.struct((x["price"] / x["was"]).alias("share"), x["price"].alias("price"), x["was"].alias("was"))))
    d = p.withColumn("sale", sale).where(F.size("sale") > 0).withColumn("b", best)
    # tags are a list or one text with commas; a list is read as the text it was
    listed = F.coalesce(F.from_json(F.when(F.ltrim("tags").startswith("["), F.col("tags")), "array<string>"), F.split(F.coalesce("tags", F.lit("")), ","))
    words = F.array_join(F.filter(F.transform(F.concat(F.array(F.coalesce("product_type", F.lit(""))), F.slice(listed, 1, 8)), fn_clean), lambda x: x != ""), " ")
    return d.select("host", fn_clean(fn_unescape(F.coalesce("title", F.lit("")))).alias("title"), "b.price", F.col("b.was").alias("regular"), F.lit("list").alias("basis"),
                    F.when(F.coalesce("handle", F.lit("")) != "", F.concat(F.lit("https://"), "host", F.lit("/products/"), "handle")).otherwise(F.concat(F.lit("https://"), "host", F.lit("/"))).alias("url"),
                    words.alias("words"), (F.size("sale") < F.size("variants")).alias("options"))


def src_woo_products(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The same of shops whose pages state prices in minor units; other currencies than dollars are left out."""
    p = spark.read.schema(WOO).json(paths).select("host", F.explode("items").alias("p")).select("host", "p.*")
    x = lambda f: F.nullif(number(F.col(f"prices.{f}")), F.lit(0.0))                              # noqa: E731
    unit = F.pow(F.lit(10.0), F.coalesce("prices.currency_minor_unit", F.lit(0)))
    d = p.where(F.coalesce("prices.currency_code", F.lit("USD")) == "USD").withColumns({"now": F.coalesce(x("sale_price"), x("price")), "was": x("regular_price"), "unit": unit}).where("was > now")
    return d.select("host", fn_clean(fn_unescape(F.regexp_replace("name", "<[^>]+>", " "))).alias("title"), rounded(F.col("now") / F.col("unit"), 2).alias("price"), rounded(F.col("was") / F.col("unit"), 2).alias("regular"),
                    F.lit("store_regular").alias("basis"), F.coalesce("permalink", F.concat(F.lit("https://"), "host", F.lit("/"))).alias("url"),
                    F.array_join(F.transform(F.slice(F.coalesce("categories", F.array().cast("array<struct<name:string>>")), 1, 6), lambda c: fn_clean(c["name"])), " ").alias("words"), F.lit(False).alias("options"))


# --- places ---

def src_places(pois: DataFrame, brands: DataFrame, merchants: DataFrame) -> DataFrame:
    """Places of the map classified to a chain: by its brand id, else by its name. Needs pois(ref, lat, lon, tags), brands(brand_id,
    chain), merchants(name, chain). Food places and shops are told apart by their tags."""
    t = lambda k: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit(""))                        # noqa: E731
    street = F.trim(F.concat_ws(" ", F.nullif(t("addr:housenumber"), F.lit("")), F.nullif(t("addr:street"), F.lit(""))))
    p = pois.withColumns({"brand_id": t("brand:wikidata"), "_b": fn_norm(t("brand")), "_n": fn_norm(t("name")), "kind": F.when(t("amenity").isin("restaurant", "fast_food", "cafe", "bar", "pub", "ice_cream"), "restaurant")
                          .when(t("shop") != "", "store").otherwise("other"), "address": F.concat_ws(", ", F.nullif(street, F.lit("")), F.nullif(t("addr:city"), F.lit("")))})
    by_name = merchants.select(fn_norm(F.col("name")).alias("k"), "chain").where("k <> ''").groupBy("k").agg(F.min("chain").alias("c"))
    p = (p.join(brands.groupBy("brand_id").agg(F.min("chain").alias("_c1")), "brand_id", "left")
         .join(by_name.select(F.col("k").alias("_b"), F.col("c").alias("_c2")), "_b", "left").join(by_name.select(F.col("k").alias("_n"), F.col("c").alias("_c3")), "_n", "left"))
    return (p.withColumns({"chain": F.coalesce("_c1", "_c2", "_c3"), "tagged": F.col("_c1").isNotNull()}).where("chain IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND kind <> 'other'")
            .select("chain", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), t("name").alias("name"), "address", "ref", "kind", "tagged"))


def src_brand_index(spark: SparkSession, paths: str | Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """Brands of a name index whose area includes the country or the world: id, name, aliases."""
    schema = "path string, items array<struct<displayName: string, tags: map<string, string>, locationSet: struct<include: array<string>>>>"
    wanted = F.lit(False)
    for x in prefixes:
        wanted = wanted | F.col("path").startswith(x)
    i = spark.read.schema(schema).json(paths).where(wanted).select(F.explode("items").alias("i")).select("i.*")
    near = F.exists(F.coalesce("locationSet.include", F.array().cast("array<string>")), lambda a: (a == "001") | F.lower(a).startswith("us"))
    tag = lambda k: F.try_element_at("tags", F.lit(k))                                             # noqa: E731
    b = i.where(near).select(tag("brand:wikidata").alias("brand_id"), F.coalesce(tag("brand"), tag("name"), "displayName").alias("name"), F.array_compact(F.array(tag("brand"), tag("name"), "displayName")).alias("a")).where("brand_id IS NOT NULL")
    names = b.select("brand_id", F.explode("a").alias("n")).distinct().groupBy("brand_id").agg(F.array_sort(F.collect_list("n")).alias("aliases"))
    return b.groupBy("brand_id").agg(F.min("name").alias("name")).join(names, "brand_id")


def src_cities(places: DataFrame, pep: DataFrame, acs: DataFrame, zctas: DataFrame, zcta_county: DataFrame, cdp_min: int = 1000) -> DataFrame:
    """One row per place: its population (estimates, else the survey), its nearest postcode and its county. Needs places(geoid, name,
    kind, lat, lon), pep(place, county, population) parts, acs(place, population), zctas(zip, lat, lon), zcta_county(zip, county,
    land)."""
    from ..operators.geojoins import jn_city_anchor
    total = pep.groupBy("place").agg(F.sum("population").alias("_pep"), F.max(F.struct("population", "county")).alias("_part"))
    df = places.withColumn("place", F.expr("substring(geoid, 3)")).join(total, "place", "left").join(acs.select("place", F.col("population").alias("_acs")), "place", "left")
    df = df.withColumn("population", F.when(F.col("kind") != "cdp", F.coalesce("_pep", "_acs")).otherwise(F.col("_acs"))).where((F.col("kind") != "cdp") | (F.coalesce("population", F.lit(0)) >= cdp_min))
    near = jn_city_anchor(df.select(F.col("geoid").alias("id"), "lat", "lon"), zctas.select(F.col("zip").alias("id"), "lat", "lon"), 15.0)
    county = zcta_county.groupBy("zip").agg(F.max(F.struct("land", "county")).alias("_z"))
    df = df.join(near.select(F.col("id").alias("geoid"), F.col("anchor").alias("zip")), "geoid").join(county, "zip", "left")
    df = df.withColumns({"county": F.coalesce("_part.county", "_z.county"), "slug": F.trim(F.regexp_replace(F.lower(F.replace("name", F.lit("'"), F.lit(""))), "[^a-z0-9]+", "-"))})
    twins = df.groupBy("slug").agg(F.count("*").alias("_n"))
    return df.join(twins, "slug").select(F.when(F.col("_n") > 1, F.concat("slug", F.lit("-"), F.lower(F.coalesce("county", F.lit(""))))).otherwise(F.col("slug")).alias("id"), "geoid", "name", "kind", "lat", "lon", "population", "zip", "county")


# --- registries ---

def src_dims(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """A dimension from JSON; Spark broadcasts it where its measured size allows."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


REGISTRY = ("id string, brand string, venue string, offer string, days array<string>, time string, until string, since string, pct double, price double, regular double, bogo string, summary string, hedge string, "
            "industries array<string>, conditions array<string>, absorbs array<string>, places array<struct<name: string, address: string, lat: double, lon: double>>, area struct<lat: double, lon: double, mi: double>, "
            "evidence array<struct<kind: string, url: string, find: array<string>, dated: string, expires_after: string, sold_out: string>>, _bad string")


def src_offer_registry(spark: SparkSession, path: str | Sequence[str], today: Column, chains: DataFrame) -> DataFrame:
    """Registry entries, each with a reason where it can't be used. `chains` has alias, chain, places."""
    from ..operators.textjoins import jn_alias_exact_prefix
    c = F.col
    e = spark.read.schema(REGISTRY).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    words = F.coalesce("days", F.array().cast("array<string>"))
    low = F.transform(words, lambda d: F.lower(F.trim(d)))
    monthly = F.filter(low, lambda d: d.rlike(r"^(?:first|second|third|fourth|last|1st|2nd|3rd|4th)\s+[a-z]+$|^\d{1,2}(?:st|nd|rd|th)$"))
    plain = F.filter(low, lambda d: ~d.rlike(r"^(?:first|second|third|fourth|last|1st|2nd|3rd|4th)\s+[a-z]+$|^\d{1,2}(?:st|nd|rd|th)$"))
    keys = {k: i for i, k in enumerate(("mon", "tue", "wed", "thu", "fri", "sat", "sun"))}
    known = lambda d: d.isin("daily", "every day", "everyday", "weekdays", "weekend", "weekends") | F.substring(d, 1, 3).isin(*keys)       # noqa: E731

    def days_of(d: Column) -> Column:
        out = F.array().cast("array<int>")
        for k, i in keys.items():
            out = F.when(F.substring(d, 1, 3) == k, F.array(F.lit(i))).otherwise(out)
        out = F.when(d == "weekdays", F.array(*[F.lit(i) for i in range(5)])).otherwise(out)
        out = F.when(d.isin("weekend", "weekends"), F.array(F.lit(5), F.lit(6))).otherwise(out)
        return F.when(d.isin("daily", "every day", "everyday"), F.array(*[F.lit(i) for i in range(7)])).otherwise(out)
    nth = {"first": 1, "1st": 1, "second": 2, "2nd": 2, "third": 3, "3rd": 3, "fourth": 4, "4th": 4, "last": -1}
    m = F.get("_monthly", 0)
    order, day = F.split_part(m, F.lit(" "), F.lit(1)), F.substring(F.split_part(m, F.lit(" "), F.lit(2)), 1, 3)
    rule = F.when(m.rlike(r"^\d{1,2}(?:st|nd|rd|th)$"), F.concat(F.lit("d:"), F.regexp_extract(m, r"^(\d+)", 1)))
    for k, i in nth.items():
        for dk, di in keys.items():
            rule = rule.when((order == k) & (day == dk), F.lit(f"{i}:{di}"))
    df = e.withColumns({"brand": F.trim(F.coalesce("brand", F.lit(""))), "offer": fn_tidy(c("offer")), "_monthly": monthly, "_plain": plain, "_u": F.try_to_date("until"), "_s": F.try_to_date("since"),
                        "_key": F.coalesce("venue", "brand")})
    has_places = F.size(F.coalesce("places", F.array().cast("array<struct<name:string,address:string,lat:double,lon:double>>"))) > 0
    bad_day = F.get(F.filter("_plain", lambda d: ~known(d)), 0)
    before = (F.when(c("_bad").isNotNull(), "could not be read").when((c("brand") == "") | (c("offer") == ""), "needs a brand and an offer").when(bad_day.isNotNull(), F.concat(F.lit("not a day: "), bad_day))
              .when((F.size("_plain") == 0) & (F.size("_monthly") == 0), "needs the days it runs on")
              .when((c("until").isNotNull() & c("_u").isNull()) | (c("since").isNotNull() & c("_s").isNull()), "dates must look like 2026-12-31").when(c("_u") < today, "past its stated end date"))
    # an entry's words are read in the tasks that read the files, before the chains are joined: one name may have most of the entries
    df = df.withColumns({"weekdays": F.array_sort(F.array_distinct(F.flatten(F.transform("_plain", days_of)))), "monthly": F.when(m.isNotNull(), F.coalesce(rule, F.lit(""))).otherwise(""), "hours": time_windows(F.coalesce("time", F.lit(""))),
                         "_before": before}).withColumns({"until": c("_u"), "since": c("_s")}).drop("_bad", "_monthly", "_plain", "_u", "_s")
    found = jn_alias_exact_prefix(df.select(c("_key").alias("name")), chains).select(c("name").alias("_key"), "chain")
    reason = F.coalesce("_before", F.when(~has_places & c("chain").isNull(), "no mapped place: give `places` with an address, or a chain the map knows"))
    return df.join(found, "_key", "left").withColumn("reason", reason).drop("_before", "_key")


# --- pages ---

def visible_text(html: Column) -> Column:
    return fn_tidy(fn_unescape(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")))


def src_html_pages(pages: DataFrame) -> DataFrame:
    """What a page shows, and the wording kept in its script blocks. Needs html."""
    scripts = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), lambda s: F.length(s) >= 40)
    strings = F.flatten(F.transform(scripts, lambda s: F.regexp_extract_all(s, F.lit(r'"((?:[^"\\]|\\.){12,900})"'), F.lit(1))))
    prose = F.filter(strings, lambda s: s.contains(" ") & ~F.substring(s, 1, 80).rlike(r"[{};=<>]|function\b|https?:"))
    return pages.withColumns({"visible": visible_text(F.col("html")), "in_scripts": fn_tidy(fn_unescape(F.array_join(F.transform(prose, lambda s: F.regexp_replace(fn_unescape_string(s), r"<[^>]+>", " ")), " ")))})


def page_date(html: Column) -> Column:
    """The page's own date: when it was modified, else published."""
    return F.coalesce(*[F.try_to_date(F.nullif(F.regexp_extract(html, rx, 1), F.lit(""))) for rx in S.PAGE_DATES])


def _plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(fn_unescape(F.regexp_replace(html, r"<[^>]+>", " ")), r"[\s\u00a0]+", " "))


def _body(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)[^>]*>.*?</\1>", " ")


def outbound(html: Column, url: Column) -> Column:
    """The first link to a site that is neither the page's own nor a social one; empty without one."""
    links = F.regexp_extract_all(html, F.lit(r'href="(https?://[^"]+)"'), F.lit(1))
    own = F.regexp_replace(F.lower(F.coalesce(F.parse_url(url, F.lit("HOST")), F.lit("-"))), r"^www\.", "")
    other = lambda x: bind(F.regexp_replace(F.lower(F.regexp_extract(x, r"^https?://([^/?#]+)", 1)), r"^www\.", ""), lambda h: (h != "") & ~F.contains(h, own) & ~h.rlike(S.NOT_A_SITE))
    return fn_unescape(F.coalesce(F.get(F.filter(links, other), 0), F.lit("")))


LISTED = ["url", "day", "brand", "section", "text", "modified", "link", "context"]


def src_roundup_lists(pages: DataFrame) -> DataFrame:
    """Entries of list pages: url, day, brand, section, text, modified, link (to the chain's site), context (who the entry's deals are for). Needs url,
    day, html, and `form` where pages of both forms are there: "items" (the one taken without it) for "Chain: sentence" list items under a heading that
    names the section, "sections" for a heading for each chain with bulleted days or paragraphs under it."""
    if "form" not in pages.columns:
        return items_of_lists(pages)
    return items_of_lists(pages.where("form = 'items'")).unionByName(sections_of_lists(pages.where("form = 'sections'")))


def items_of_lists(pages: DataFrame) -> DataFrame:
    """List items, with the section that the headings before them name carried down the page's own blocks."""
    blocks = F.regexp_extract_all(_body(F.col("html")), F.lit(r"(?is)(<(?:h2|h3|li)[^>]*>.*?</(?:h2|h3|li)>)"), F.lit(1))

    def walk(acc: Column, b: Column) -> Column:
        head = F.lower(_plain(b))
        section = F.when(head.contains("limited-time"), "limited").when(head.startswith("weekend"), "weekend").when(head.startswith("every"), "every").otherwise("")
        is_item = b.rlike(r"(?i)^<li")
        entry = F.struct(acc["section"].alias("section"), _plain(b).alias("text"), b.alias("html"))
        return F.struct(F.when(is_item, acc["section"]).otherwise(section).alias("section"),
                        F.when(is_item & (acc["section"] != ""), F.array_append(acc["out"], entry)).otherwise(acc["out"]).alias("out"))
    start = F.struct(F.lit("").alias("section"), F.array().cast("array<struct<section:string,text:string,html:string>>").alias("out"))
    e = pages.select("url", "day", page_date(F.col("html")).alias("modified"), F.explode(F.aggregate(blocks, start, walk)["out"]).alias("e"))
    rx = r"(?s)^([^:]{2,60}?)\s*:\s*(\S.{15,})$"
    d = e.select("url", "day", "modified", "e.section", F.trim(F.regexp_replace(F.regexp_extract("e.text", rx, 1), r"\s*\([^)]*\)\s*$", "")).alias("brand"), F.trim(F.regexp_extract("e.text", rx, 2)).alias("text"),
                 outbound(F.col("e.html"), F.col("url")).alias("link"), F.lit("").alias("context")).where("brand <> ''")
    d = d.where(~(F.col("brand").rlike(r"\d") & F.col("brand").rlike(r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)")))
    ends = F.filter(weekdays_in(F.col("text")), lambda x: x >= 5)
    days = F.when(F.col("section") == "weekend", F.when(F.size(ends) > 0, ends).otherwise(F.array(F.lit(5), F.lit(6)))).otherwise(F.array(F.col("day").cast("int")))
    return d.withColumn("day", F.explode(days)).select(*LISTED)


def sections_of_lists(pages: DataFrame) -> DataFrame:
    """Sections, one row each from the start. A bulleted line that names the page's day is an entry, with the paragraph before its list as context.
    The paragraphs make one entry: the sentences that name the day, and short or restricting ones that follow on. That is a fold over the
    section's sentences in order, whose state is the distance to the last sentence kept: another day or another offer sends it out of reach."""
    c = F.col
    far = F.lit(99)
    cut_up = F.filter(F.slice(F.split(_body(c("html")), r"(?i)<h2[^>]*>"), 2, 100_000), lambda s: s.contains("</h2>"))
    sec = (pages.select("url", c("day").cast("int").alias("day"), page_date(c("html")).alias("modified"), F.explode(cut_up).alias("_s"))
           .withColumns({"brand": _plain(F.substring_index("_s", "</h2>", 1)), "_rest": F.expr("substring(_s, instr(_s, '</h2>') + 5)")})
           .where((c("brand") != "") & (F.length("brand") <= 45) & ~says(c("brand"), S.SKIP_HEAD))
           .withColumn("link", outbound(c("_rest"), c("url"))))
    # bulleted days
    blocks = F.regexp_extract_all("_rest", F.lit(r"(?is)(<p[^>]*>.*?</p>|<ul[^>]*>.*?</ul>)"), F.lit(1))
    is_list = lambda b: b.rlike(r"(?i)^<ul")
    lines = F.transform(c("_blocks"), lambda b, i: F.when(is_list(b), F.transform(F.regexp_extract_all(b, F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1)), lambda x: F.struct(
        _plain(x).alias("text"), F.coalesce(F.element_at(F.filter(F.slice("_blocks", 1, i), lambda p: ~is_list(p)), -1), F.lit("")).alias("intro")))))
    bullets = (sec.withColumn("_blocks", blocks).withColumn("_line", F.explode(F.flatten(F.array_compact(lines)))).select("*", c("_line.text").alias("text"), _plain(c("_line.intro")).alias("context"))
               .where(F.length("text").between(12, 400)).where(F.array_contains(weekdays_in(c("text"), every_day=False), c("day"))))
    # paragraphs: the sentences with what the fold asks of each
    def told(p: Column) -> Column:  # noqa: E306
        def of(s: Column, i: Column) -> Column:
            days = weekdays_in(s)
            return F.struct(s.alias("s"), (i == 0).alias("opens"), says(s, S.FILLER).alias("filler"), F.array_contains(days, c("day")).alias("ours"), (F.size(days) > 0).alias("dated"), says(s, S.OTHER_OFFER).alias("other"),
                            (F.length(s) <= 70).alias("short"), ((F.length(s) <= 220) & says(F.translate(s, "\u2019\u2018", "''"), S.QUALIFIES) & ~says(s, S.HOW_KNOWN)).alias("limits"))
        return F.transform(F.filter(F.split(_plain(p), S.SENTENCE_END), lambda s: s != ""), of)
    paragraphs = F.flatten(F.transform(F.regexp_extract_all("_rest", F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), told))

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["opens"], far).otherwise(acc["gap"])

        def next_(g: Column) -> Column:
            away = x["dated"] | x["other"]
            follows = ~away & (((g + 1 == 1) & x["short"]) | ((g + 1 <= 3) & x["limits"]))
            keep = ~x["filler"] & (x["ours"] | follows)
            after = F.when(x["filler"], g).when(x["ours"], F.when(x["other"], far).otherwise(F.lit(0))).when(away, far).when(follows, F.lit(0)).otherwise(g + 1)
            return F.struct(F.when(keep, F.array_append(acc["kept"], x["s"])).otherwise(acc["kept"]).alias("kept"), after.cast("int").alias("gap"))
        return bind(gap, next_)
    start = F.struct(F.array().cast("array<string>").alias("kept"), far.cast("int").alias("gap"))
    folded = sec.withColumn("_told", paragraphs).withColumn("_kept", F.aggregate("_told", start, step)["kept"]).where(F.size("_kept") > 0)
    lead = F.coalesce(F.get("_told", F.lit(0))["s"], F.lit(""))
    prose = folded.withColumns({"text": F.substring(F.array_join(F.array_distinct("_kept"), " "), 1, 700), "context": F.when(F.array_contains("_kept", lead), "").otherwise(lead)})
    shown = lambda df: df.withColumn("section", F.lit("every")).select(*LISTED)
    return shown(bullets).unionByName(shown(prose))
