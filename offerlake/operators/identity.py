"""Product identity: which listings on different sites are one product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fn_norm
from ..functions.amounts import bind
from ..rules import products as P
from ..session import cut
from .wordwork import ci, got, matches, says


def norm_model(token: Column) -> Column:
    return F.regexp_replace(F.upper(F.split_part(token, F.lit("/"), F.lit(1))), "[^A-Z0-9]", "")


def models_of(title: Column, brand: Column) -> Column:
    """Model numbers in a title, the likeliest first; sizes, specs, years and product lines are none."""
    styles = F.transform(F.regexp_extract_all(title, F.lit(P.STYLE_CODE), F.lit(1)), norm_model)
    tokens = F.transform(F.regexp_extract_all(title, F.lit(P.MODEL_TOKEN), F.lit(1)), lambda t: F.regexp_replace(t, r"^[.\-/]+|[.\-/]+$", ""))

    def is_model(x: Column) -> Column:
        n, upper = x["n"], F.replace(F.upper(x["t"]), F.lit("-"), F.lit(""))
        named = lambda letters: ((letters != "") & ~letters.isin(*P.WORDISH) & ~n.rlike(P.SPEC) & ~upper.rlike(P.SPEC) & ~(n.rlike(r"^\d+[A-Z]{1,2}$") & ~n.rlike(r"^\d{3,}[A-Z]{2}$"))
                                 & ~n.rlike(r"^[A-Z]{5,}\d{1,3}$") & (n != norm_model(F.coalesce(brand, F.lit("")))))
        return (F.length(n) >= 4) & (F.length(F.regexp_replace(n, r"\D", "")) >= 2) & bind(F.regexp_replace(n, "[^A-Z]", ""), named)
    spelled = F.transform(tokens, lambda t: F.struct(t.alias("t"), norm_model(t).alias("n")))
    found = F.array_distinct(F.concat(styles, F.transform(F.filter(spelled, is_model), lambda x: x["n"])))
    ranked = F.array_sort(F.transform(found, lambda m, i: F.struct(F.when(F.length(m) >= 6, 0).otherwise(1).alias("l"), (-F.length(m)).alias("n"), i.alias("i"), m.alias("m"))))
    sets = F.filter(F.regexp_extract_all(title, F.lit(P.SET_NUMBER), F.lit(1)), lambda x: ~x.rlike(r"^(?:19|20)\d\d$"))
    return F.when(F.lower(F.coalesce(brand, F.lit(""))) == "lego", sets).otherwise(F.transform(ranked, lambda x: x["m"]))


def named_model(title: Column, named: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    brand, model = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for rx, b, m in named:
        one = F.lit(m)
        if "{0}" in m:
            a, z = m.split("{0}")
            one = F.concat(F.lit(a), F.replace(F.upper(F.coalesce(got(title, rx, 1), F.lit(""))), F.lit(" "), F.lit("")), F.lit(z))
        brand, model = brand.when(says(title, rx), F.lit(b)), model.when(says(title, rx), one)
    return brand, model


def job_identity(titles: DataFrame, brands: DataFrame, named: Sequence[tuple[str, str, str]] = tuple(P.NAMED)) -> DataFrame:
    """Brand, models, size-like attributes and whether it is an accessory. Needs titles(id, title, brand_hint, gtin),
    brands(brand). A title's brand is its one to three leading words, longest first, looked up by join."""
    c = F.col
    head = F.trim(F.regexp_replace(c("title"), ci(P.PREFIX_NOISE), ""))
    words = F.regexp_extract_all(head, F.lit(r"([\w'+&.!-]+)"), F.lit(1))
    tries = F.transform(F.array(F.lit(3), F.lit(2), F.lit(1)), lambda n: F.when(F.size(words) >= n, F.struct(n.alias("n"), F.regexp_replace(
        F.lower(F.array_join(F.slice(words, 1, n), " ")), "[^a-z0-9]", "").alias("key"))))
    known = brands.select(F.regexp_replace(F.lower("brand"), "[^a-z0-9]", "").alias("key"), "brand").dropDuplicates(["key"])
    hint = F.coalesce(c("brand_hint"), F.lit(""))
    df = titles.withColumn("_try", F.when(hint != "", F.array(F.struct(F.lit(9).alias("n"), F.regexp_replace(F.lower(hint), "[^a-z0-9]", "").alias("key"))))
                           .otherwise(F.array_compact(tries)))
    hit = (df.select("id", F.explode("_try").alias("t")).select("id", "t.n", "t.key").join(known, "key").groupBy("id").agg(F.max_by("brand", "n").alias("_known")))
    df = df.join(hit, "id", "left")
    nb, nm = named_model(c("title"), named)
    df = df.withColumns({"_nb": nb, "_nm": nm})
    df = df.withColumn("brand", F.coalesce("_known", F.nullif(F.trim(hint), F.lit("")), "_nb", F.lit("")))
    models = models_of(c("title"), c("brand"))
    df = df.withColumn("models", F.when(c("_nm").isNotNull(), F.concat(F.array("_nm"), F.filter(models, lambda m: m != c("_nm")))).otherwise(models))
    cond, pack = F.lower(got(c("title"), P.CONDITION)), got(c("title"), P.PACK)
    storage = F.array_sort(F.array_distinct(F.transform(matches(c("title"), P.STORAGE), lambda m: F.upper(F.regexp_replace(m, r"\s", "")))))
    kinds = F.array_sort(F.array_distinct(F.transform(matches(c("title"), P.KIND), lambda k: F.regexp_replace(F.replace(F.lower(k), F.lit(" "), F.lit("")), "s$", ""))))
    model = F.coalesce(F.get("models", 0), F.lit(""))
    df = df.withColumns({
        "gtin": F.regexp_replace(F.coalesce(c("gtin"), F.lit("")), r"\D", ""), "model": model,
        "screen": got(c("title"), P.SCREEN), "storage": F.nullif(F.array_join(storage, ","), F.lit("")), "oz": got(c("title"), P.OUNCES),
        "pack": F.when(pack.try_cast("int") > 1, pack), "kinds": F.array_join(kinds, ","), "bundle": says(c("title"), P.BUNDLE),
        "condition": F.when(cond.isin("open-box", "open box"), "open-box").when(cond.isNotNull(), "refurbished").otherwise("new"),
        "accessory": says(c("title"), P.ACCESSORY) | (F.size("models") >= 3)})
    return df.withColumn("product_key", F.when(c("gtin") != "", F.concat(F.lit("gtin:"), "gtin"))
                         .when((c("brand") != "") & (c("model") != ""), F.concat(F.lower("brand"), F.lit("|"), "model")).otherwise("")).drop("_try", "_known", "_nb", "_nm", "brand_hint")


SIZES = ["screen", "storage", "oz", "pack"]
IDENTITY = ["gtin", "models", "brand", "kinds", "accessory", "bundle", "condition", *SIZES]


def with_sig(df: DataFrame) -> DataFrame:
    """Adds `sig`, equal for titles of equal identity: many copies of a title are compared once."""
    parts = [F.array_join(F.col("models"), ","), *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in IDENTITY if x != "models"]]
    return df.withColumn("sig", F.md5(F.concat_ws("|", *parts)))


def _of_model(side: str, gtin: str) -> Column:
    """What stands for all of an identity but its gtin, and whether it has one."""
    return F.md5(F.concat_ws("|", F.array_join(F.col(f"{side}_models"), ","), *[F.coalesce(F.col(f"{side}_{x}").cast("string"), F.lit("")) for x in IDENTITY if x not in ("models", "gtin")], F.lit(gtin)))


def jn_same_product(deals: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which identities among deals and listings are the same product, by the lots that listings lie in: (deal_sig, lot, match) and
    (listing_sig, lot). A deal is the same product as the listings of its lots, and no listing lies in two lots of one deal. Equal gtins decide
    alone; else a shared model and nothing that conflicts. Both need the identity columns.

    All that have a gtin are one lot, so it makes no pairs. By model, identities are compared without their gtins, found by their first shared
    model and the parts that must be equal; a deal without a gtin has the whole lot of such an identity, one with a gtin its listings without."""
    c = F.col
    a = with_sig(deals).groupBy("sig").agg(*[F.first(x).alias(f"a_{x}") for x in IDENTITY]).withColumnRenamed("sig", "deal_sig")
    b = with_sig(listings).groupBy("sig").agg(*[F.first(x).alias(f"b_{x}") for x in IDENTITY]).withColumnRenamed("sig", "listing_sig")
    a, b = cut(a.withColumn("_a", _of_model("a", ""))), cut(b.withColumn("_b", _of_model("b", "")))
    gtin = lambda side: F.concat(F.lit("gtin~"), F.regexp_replace(c(f"{side}_gtin"), "^0+", ""))
    lots = (b.where("b_gtin <> ''").select("listing_sig", gtin("b").alias("lot"))
            .unionByName(b.select("listing_sig", F.explode(F.array(F.concat(F.lit("any~"), "_b"), F.when(~(c("b_gtin") != ""), F.concat(F.lit("bare~"), "_b")))).alias("lot")).where("lot IS NOT NULL")))
    by_gtin = a.where("a_gtin <> ''").select("deal_sig", gtin("a").alias("lot"), F.lit("gtin").alias("match"))

    facts = [x for x in IDENTITY if x != "gtin"]
    one = lambda df, s: df.groupBy(f"_{s}").agg(*[F.first(f"{s}_{x}").alias(f"{s}_{x}") for x in facts]).withColumns({                    # noqa: E731
        "_k": F.explode(F.array_distinct(f"{s}_models")), "_brand": F.lower(f"{s}_brand")})
    equal = ["_k", *[f"_{x}" for x in ("accessory", "kinds", "bundle", "condition")]]
    am, bm = (one(df, s).withColumns({f"_{x}": c(f"{s}_{x}") for x in ("accessory", "kinds", "bundle", "condition")}) for df, s in ((a, "a"), (b, "b")))
    agree = F.lit(True)
    for s in SIZES:
        agree = agree & F.coalesce(c(f"a_{s}") == c(f"b_{s}"), F.lit(True))
    agree = agree & (F.get(F.array_intersect("a_models", "b_models"), 0) == c("_k"))
    named, bare = c("a_brand") != "", ~(c("b_brand") != "")
    met = am.where(named).join(bm.where(~bare).drop("_brand").withColumn("_brand", F.lower("b_brand")), [*equal, "_brand"]).drop("_brand")
    met = met.unionByName(am.where(named).drop("_brand").join(bm.where(bare).drop("_brand"), equal)).unionByName(am.where("a_brand = ''").drop("_brand").join(bm.drop("_brand"), equal))
    pairs = met.where(agree).select("_a", "_b")
    has = F.when(c("a_gtin") != "", "bare~").otherwise("any~")
    by_model = a.select("deal_sig", "_a", has.alias("_has")).join(pairs, "_a").select("deal_sig", F.concat("_has", "_b").alias("lot"), F.lit("model").alias("match"))
    # a lot that no listing lies in is none
    return by_model.unionByName(by_gtin).join(lots.select("lot").distinct(), "lot", "left_semi").select("deal_sig", "lot", "match"), lots


def compare_listings(deals: DataFrame, listings: DataFrame, lo: float = 0.35, hi: float = 3.0) -> DataFrame:
    """deal, site, price, match: the cheapest matching listing of each site for each deal, in the band of believable prices
    and not at the seller's own site. Needs deals(id, seller, price) and listings(site, price) with identity columns. Equal
    offers and equal listings are compared once."""
    deals, listings = cut(deals), cut(listings)           # read twice each, and costly to make
    d = with_sig(deals).select("id", "seller", "price", F.col("sig").alias("deal_sig"))
    same, of = jn_same_product(deals, listings)
    same = cut(same)
    lots = with_sig(listings).select(F.col("sig").alias("listing_sig"), "site", F.col("price").alias("listing_price")).distinct().join(of, "listing_sig").select(F.col("lot").alias("listing_sig"), "site", "listing_price").distinct()
    asked = d.select("deal_sig", F.col("price").alias("deal_price")).distinct().join(same.withColumnRenamed("lot", "listing_sig"), "deal_sig")
    found = jn_price_band(asked.select("listing_sig", "deal_price").distinct(), lots, lo, hi)
    best = asked.join(found, ["listing_sig", "deal_price"]).groupBy("deal_sig", "deal_price", "site").agg(F.min(F.struct("listing_price", "match")).alias("b"))
    own = F.lower(F.coalesce("seller", F.lit(""))) == F.lower("site")
    return (d.join(best, (d.deal_sig == best.deal_sig) & (d.price == best.deal_price)).where(~own)
            .select(F.col("id").alias("deal"), "site", F.col("b.listing_price").alias("price"), "b.match"))


STEP = 1.25     # prices are dealt to buckets by their logarithm: about a hundred cover all there are


def jn_price_band(asked: DataFrame, lots: DataFrame, lo: float = 0.35, hi: float = 3.0) -> DataFrame:
    """listing_sig, deal_price, site, listing_price: for each price asked of a product the cheapest listing of each site that costs what the
    product can cost. Needs asked(listing_sig, deal_price), lots(listing_sig, site, listing_price), both distinct.

    An as-of join instead of offers times listings: the wanted listing is the first at or above `lo` times the price. Each product and site has one
    row of its price buckets with the least price of each, so the buckets above the one that the bound falls into are looked up in it; inside
    that bucket bounds and prices are sorted together. Rows made are the prices asked times the sites."""
    c = F.col
    bucket = lambda v: F.floor(F.log(F.greatest(v, F.lit(0.001))) / F.log(F.lit(STEP))).cast("int")
    lots = lots.withColumn("_bucket", bucket(c("listing_price")))
    least = lots.groupBy("listing_sig", "site", "_bucket").agg(F.min("listing_price").alias("m"))
    tops = least.groupBy("listing_sig", "site").agg(F.collect_list(F.struct("_bucket", "m")).alias("_tops"))
    probes = (asked.join(tops, "listing_sig").withColumn("_bound", F.lit(lo) * c("deal_price")).withColumn("_bucket", bucket(c("_bound")))
              .withColumn("_above", F.array_min(F.transform(F.filter("_tops", lambda x: x["_bucket"] > c("_bucket")), lambda x: x["m"]))).drop("_tops"))
    rows = (probes.select("listing_sig", "site", "_bucket", c("_bound").alias("_at"), F.lit(1).alias("_asks"), "deal_price", "_above")
            .unionByName(lots.select("listing_sig", "site", "_bucket", c("listing_price").alias("_at"), F.lit(0).alias("_asks")), allowMissingColumns=True))
    from_top = Window.partitionBy("listing_sig", "site", "_bucket").orderBy(F.desc("_at"), "_asks").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.last(F.when(c("_asks") == 0, c("_at")), ignorenulls=True).over(from_top)
    found = rows.withColumn("_inside", inside).where("_asks = 1").withColumn("listing_price", F.coalesce("_inside", "_above"))
    return found.where(c("listing_price") <= F.lit(hi) * c("deal_price")).select("listing_sig", "deal_price", "site", "listing_price")


STOP = "with for and the free shipping shipped only just deal amazon prime members pack count new set off now via from your this that".split()


def dd_same_listing(pairs: DataFrame, share: float = 0.5) -> DataFrame:
    """Whether a product page is what a post is about: half of the post's distinctive words, and the brand where the post
    names it. Needs post_title, page_title, brand."""
    words = lambda t: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"([a-z0-9]{3,})"), F.lit(1)),            # noqa: E731
                                                lambda w: ~w.isin(*STOP) & ~w.rlike(r"^\d+$")))
    pw, aw = words(F.regexp_replace("post_title", r"\$\s?[\d,.]+", " ")), words(F.coalesce("page_title", F.lit("")))
    brand = fn_norm(F.col("brand"))
    lost = (brand != "") & fn_norm(F.col("post_title")).contains(brand) & ~fn_norm(F.col("page_title")).contains(brand)
    return pairs.withColumn("same", (F.size(pw) > 0) & (F.size(aw) > 0) & ~lost & (F.size(F.array_intersect(pw, aw)) >= share * F.size(pw)))
