"""Checks of results against their sources. Each gives a verdict (pass, fail, inconclusive) and the issues found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fn_host, fn_money, fn_norm, fn_phrase_near, fn_tidy
from ..functions.amounts import bind, number, rounded
from ..functions.times import seconds_between
from ..rules import wordings as R
from ..session import cut
from .filters import flt_sale_live, is_product_link  # noqa: F401
from .fuzzy import sale_words, similar_pairs
from .geojoins import within
from .sales import stated_end, stated_range
from .terms import plain_page, title_words
from .wordwork import ci, matches, says

Issue = tuple[str, Column]


def verdict(df: DataFrame, issues: Sequence[Issue], unless: Sequence[Issue] = ()) -> DataFrame:
    """Adds issues and verdict; a condition of `unless` that holds makes it inconclusive."""
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in issues]))
    unclear = F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in unless]) if unless else F.lit(None).cast("string")
    df = df.withColumns({"_unclear": unclear, "_found": found})
    return df.withColumns({
        "issues": F.when(F.col("_unclear").isNotNull(), F.array("_unclear")).otherwise(F.col("_found")),
        "verdict": F.when(F.col("_unclear").isNotNull(), "inconclusive").when(F.size("_found") > 0, "fail").otherwise("pass")}).drop("_unclear", "_found")


def off(a: Column, b: Column, by: float | Column) -> Column:
    return F.coalesce(F.abs(a - b) > by, F.lit(False))


def dq_math(deals: DataFrame, source: DataFrame) -> DataFrame:
    """Percent, saving and regular price follow from each other and from the source's fields. Needs deals(id, price, regular,
    pct, savings, bogo, qty, basis), source(id, percent_off, dollars_off, original_price, text)."""
    c = F.col
    df = deals.join(source.select("id", "percent_off", "dollars_off", "original_price", "text"), "id", "left")
    bogo, one = F.coalesce(c("bogo"), F.lit("")) != "", F.coalesce(c("qty"), F.lit(1)) == 1
    plain = ~bogo & one
    exp = rounded((1 - c("price") / c("regular")) * 100, 1)
    return verdict(df, [
        ("percent doesn't follow from the prices", ~bogo & off(exp, c("pct"), 0.15)), ("saving doesn't follow from the prices", ~bogo & off(c("regular") - c("price"), c("savings"), 0.011)),
        ("a buy-and-get offer not read as one", ~bogo & says(c("text"), r"\bBOGO\b|\bbuy \d+,? get \d+\b|\bbuy one,? get one\b")),
        ("percent differs from the source", plain & off(c("percent_off"), c("pct"), 1.5)), ("saving differs from the source", plain & (c("basis") != "list") & off(c("dollars_off"), c("savings"), 0.02)),
        ("regular price differs from the source", one & off(c("original_price"), c("regular"), 0.02))])


def dq_window(deals: DataFrame, source: DataFrame, start: Column, end: Column) -> DataFrame:
    """A deal's window and its day labels agree with the source's dates. Needs deals(id, starts_in_days, ends_in_days), source(id,
    start_local, end_local, start_day, end_day, today)."""
    c = F.col
    df = deals.join(source, "id", "left")
    return verdict(df, [
        ("outside the window", (c("end_local") < start) | (c("start_local") > end)), ("'ends in' label is wrong", F.datediff("end_day", "today") != c("ends_in_days")),
        ("'starts in' label is wrong", F.greatest(F.lit(0), F.datediff("start_day", "today")) != c("starts_in_days"))],
        [("the source gives no dates", c("start_local").isNull() | c("end_local").isNull())])


def dq_fidelity(deals: DataFrame, source: DataFrame) -> DataFrame:
    """What is shown is what the source says: title, merchant, price, dates. Needs id, title, merchant, price, valid_from,
    valid_to on both."""
    c = F.col
    s = source.select("id", *[c(x).alias(f"s_{x}") for x in ("title", "merchant", "price", "valid_from", "valid_to")], F.lit(True).alias("_there"))
    df = deals.join(s, "id", "left")
    gone = c("_there").isNull()
    return verdict(df, [
        ("the item no longer exists at the source", gone), ("merchant", ~gone & ~c("s_merchant").eqNullSafe(c("merchant"))), ("title", ~gone & (fn_norm(c("s_title")) != fn_norm(c("title")))),
        ("price", off(c("s_price"), c("price"), 0.011)), ("dates", F.coalesce((c("s_valid_from") != c("valid_from")) | (c("s_valid_to") != c("valid_to")), F.lit(False)))]).drop("_there")


def dq_vicinity(deals: DataFrame, listed: DataFrame, mapped: DataFrame, radius_mi: float, complete: float = 0.5) -> DataFrame:
    """The chain's own list has a branch within the radius. Needs deals(id, chain, lat, lon), listed(chain, lat, lon), mapped(chain,
    places); a list that holds less than `complete` of the mapped places proves nothing."""
    near = within(deals.select("id", "chain", "lat", "lon"), listed, radius_mi, on=("chain",)).select("id").withColumn("_near", F.lit(True))
    counts = listed.groupBy("chain").agg(F.count("*").alias("_listed")).join(mapped, "chain", "full").select("chain", F.coalesce("_listed", F.lit(0)).alias("_listed"), F.coalesce("places", F.lit(0)).alias("_mapped"))
    df = deals.join(near, "id", "left").join(counts, "chain", "left")
    return verdict(df, [("the chain's own list shows no branch within the radius", F.col("_near").isNull())],
                   [("no list for this chain", F.coalesce("_listed", F.lit(0)) == 0), ("the list looks incomplete", F.col("_listed") < complete * F.col("_mapped"))]).drop("_near", "_listed", "_mapped")


def dq_ranking(deals: DataFrame, now: Column) -> DataFrame:
    """A ranked list holds together. Needs id, list, pos, score, basis, price, reference_price, market_median, pct, verified_pct,
    sites, title, posted_at, expires_at, product_key. Neighbours and duplicates are found by key, not in one pass over a list."""
    c = F.col
    before = deals.select("list", (c("pos") + 1).alias("pos"), c("score").alias("_before"))
    twice = deals.where("product_key <> ''").groupBy("list", "product_key").agg(F.count("*").alias("_same")).where("_same > 1")
    df = deals.join(before, ["list", "pos"], "left").join(twice, ["list", "product_key"], "left")
    market = c("basis") == "market"
    fresh = F.coalesce(seconds_between(c("posted_at"), now) <= 73 * 3600, F.lit(False)) | F.coalesce(c("expires_at") > now, F.lit(False))
    return verdict(df, [
        ("market basis without two comparisons", market & (c("market_median").isNull() | (c("sites") < 2))),
        ("verified percent doesn't follow from the median", market & (c("verified_pct") != 0) & off((1 - c("price") / c("market_median")) * 100, c("verified_pct"), 0.15)),
        ("percent doesn't follow from the reference", ~market & off((1 - c("price") / c("reference_price")) * 100, c("pct"), 0.15)), ("a sale on many products in the product list", says(c("title"), R.STOREWIDE)),
        ("older than 72 hours with no later end", ~fresh), ("ranked above a better one", c("_before") + 1e-6 < c("score")), ("the same product twice", c("_same").isNotNull())]).drop("_before", "_same")


def dq_comparison(points: DataFrame) -> DataFrame:
    """A matched listing, read again, is still the same product at about the price shown. Needs same (jn_same_product of the page
    read again), price, page_price, page_title."""
    c = F.col
    return verdict(points, [("not the same product", ~F.coalesce(c("same"), F.lit(False))), ("no price on the page", c("page_price").isNull()),
                            ("another price", off(c("page_price"), c("price"), F.greatest(F.lit(1.0), c("price") * 0.02)))], [("the page has no product title", F.coalesce(c("page_title"), F.lit("")) == "")])


def dq_offer_numbers(sales: DataFrame) -> DataFrame:
    """Every figure of a badge and an offer stands in the title; a firm percent is no ceiling; the code is in the post. Needs title,
    badge, offer, pct, upto, code, text."""
    c = F.col
    nums = lambda t, rx: F.transform(matches(t, rx), lambda m: number(F.regexp_extract(m, r"(\d[\d,]*)", 1)))      # noqa: E731
    pct, usd = r"\d{1,3}\s?%", r"\$\s?\d[\d,]*"
    shown = F.concat_ws(" ", "badge", F.lit("|"), "offer")
    # a range's first figure has no sign of its own in the badge
    said = F.transform(F.regexp_extract_all(c("title"), F.lit(r"(\d{1,3})\s?%"), F.lit(1)), lambda x: x.cast("double"))
    ceiling = F.exists(F.transform(matches(c("title"), R.UPTO_PCT), lambda m: number(F.regexp_extract(m, ci(R.UPTO_PCT), 1))), lambda x: x == c("pct"))
    code = F.coalesce(c("code"), F.lit(""))
    return verdict(sales, [("a percent is not in the title", F.size(F.array_except(nums(shown, pct), said)) > 0), ("an amount is not in the title", F.size(F.array_except(nums(shown, usd), nums(c("title"), usd))) > 0),
                           ("shown as firm but the title says up to", c("pct").isNotNull() & c("upto").isNull() & ceiling),
                           ("the code is not in the post", (code != "") & ~F.concat_ws(" ", "title", "text").contains(code)), ("a word, not a code", F.upper(code).isin("CODE", "PROMO", "NEEDED", "REQUIRED", "COUPON"))])


def dq_sales_list(sales: DataFrame, now: Column) -> DataFrame:
    """(check, problems) of a whole list of sales: duplicates, stale ones, order, incomplete cards. Needs id, pos, store, store_name,
    badge, name, offer, ends_at, starts_at, posted_at, score, source_url, categories."""
    block = F.concat_ws("|", F.coalesce(F.nullif("store", F.lit("")), "store_name"), "badge", F.coalesce(F.date_format("ends_at", "yyyy-MM-dd"), F.lit("")))
    lacks = F.exists(F.array("store_name", "name", "offer", "badge", "source_url"), lambda x: F.coalesce(x, F.lit("")) == "") | (F.size("categories") == 0) | ~F.col("source_url").startswith("https://")
    # the list is made once, and what the checks need of it written down; so are its wordings, which are looked up several times
    s = cut(flt_sale_live(sales, now).select("id", "pos", "score", block.alias("block"), sale_words(F.col("name")).alias("words"),
                                             F.expr("reason IS NOT NULL AND reason NOT LIKE 'sale: starts%'").alias("stale"), lacks.alias("lacks")))
    groups = cut(s.groupBy("block", "words").agg(F.min("id").alias("node"), F.count("*").alias("n")))
    copies = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("p"))
    near = similar_pairs(groups.where(F.size("words") > 0).select("node", "block", "words"), "block", 0.6, "overlap").agg(F.count("*").alias("p"))
    stale = s.where("stale").agg(F.count("*").alias("p"))
    before = s.select((F.col("pos") + 1).alias("pos"), F.col("score").alias("before"))
    order = s.select("pos", "score").join(before, "pos").where("score > before").agg(F.count("*").alias("p"))
    incomplete = s.where("lacks").agg(F.count("*").alias("p"))
    out = None
    for name, df in (("same wording", copies), ("similar wording", near), ("fresh", stale), ("order", order), ("complete", incomplete)):
        one = df.select(F.lit(name).alias("check"), F.col("p").cast("bigint").alias("problems"))
        out = one if out is None else out.unionByName(one)
    return out


def dq_end_dates(sales: DataFrame, stated: DataFrame) -> DataFrame:
    """The end shown is one the post states. Needs sales(id, end_day, ends_how), stated(id, days array)."""
    c = F.col
    df = sales.join(stated.select("id", "days"), "id", "left").withColumn("days", F.coalesce("days", F.array().cast("array<date>")))
    has = F.exists("days", lambda d: (d == c("end_day")) | (c("ends_how").endswith("end date") & (F.abs(F.datediff(d, c("end_day"))) <= 1)))
    return verdict(df, [("the post states an end that is not shown", c("end_day").isNull() & (F.size("days") > 0)), ("the post states a different end", c("end_day").isNotNull() & (F.size("days") > 0) & ~has)])


GOOD_REASONS = ("nearest store", "no store within", "item already ended", "item starts after", "same item in", "implausible saving")


def dq_recall(source: DataFrame, results: DataFrame, reasons: DataFrame) -> DataFrame:
    """Each qualifying source item is shown, or was left out for a reason that holds. Needs source(id), results(id), reasons(id,
    reason)."""
    df = (source.join(results.select("id").distinct().withColumn("_shown", F.lit(True)), "id", "left")
          .join(reasons.groupBy("id").agg(F.min("reason").alias("_why")), "id", "left"))
    good = F.lit(False)
    for g in GOOD_REASONS:
        good = good | F.col("_why").startswith(g)
    shown = F.col("_shown").isNotNull()
    return verdict(df, [("missing with no recorded reason", ~shown & F.col("_why").isNull()), ("left out without a good reason", ~shown & F.coalesce(~good, F.lit(False)))],
                   [("the source's category is overridden on purpose", ~shown & F.coalesce(F.col("_why").startswith("other"), F.lit(False)))]).drop("_shown", "_why")


def dq_replay(got: DataFrame, expected: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """What the jobs make of fixed posts against what is expected: differences only."""
    from .textjoins import jn_full_diff
    return jn_full_diff(expected, got, key, columns)


def has_price(text: Column, price: Column) -> Column:
    """Whether a price is written in a text, with or without separators and cents."""
    found = F.transform(matches(text, r"\$\s?\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\$\s?\d+(?:\.\d{1,2})?"), fn_money)
    return F.exists(found, lambda v: F.abs(v - price) < 0.005)


def dq_post_page(posts: DataFrame, pages: DataFrame) -> DataFrame:
    """A post's page still shows its price and half of its title's words, and is not marked expired. Needs posts(url, title, price),
    pages(url, html)."""
    df = posts.join(pages.select("url", plain_page(F.col("html")).alias("_plain")), "url", "left").withColumn("_w", title_words(F.col("title")))
    low = F.lower("_plain")
    return verdict(df, [("the price is not on the page", (F.col("price") > 0) & ~has_price(F.col("_plain"), F.col("price"))),
                        ("title words missing from the page", (F.size("_w") > 0) & (F.size(F.filter("_w", lambda w: low.contains(w))) < 0.5 * F.size("_w"))),
                        ("the post is marked expired", says(F.col("_plain"), R.EXPIRED_MARK))], [("no page", F.col("_plain").isNull())]).drop("_plain", "_w")


LD_JSON = r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"


def page_offer(html: Column) -> Column:
    """The first price that a page's structured data states for a product: in every block, objects and lists are opened level by level,
    as deep as the block has brackets, and each node of type Product is asked for its offers, one or a list."""
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LD_JSON), F.lit(1))
    nothing = F.array().cast("array<string>")
    inside = lambda n: F.coalesce(F.from_json(n, "array<string>"), F.map_values(F.from_json(n, "map<string,string>")), nothing)      # noqa: E731
    opened = lambda ns: F.flatten(F.transform(F.filter(ns, lambda n: F.ltrim(n).rlike(r"^[\[{]")), inside))                             # noqa: E731
    depth = lambda b: F.length(b) - F.length(F.translate(b, "{[", ""))                                                                # noqa: E731

    def nodes(block: Column) -> Column:
        start = F.struct(F.array(block).alias("level"), F.array(block).alias("all"))
        step = lambda acc, _: F.when(F.size(acc["level"]) == 0, acc).otherwise(bind(opened(acc["level"]), lambda ns: F.struct(ns.alias("level"), F.concat(acc["all"], ns).alias("all"))))
        return F.aggregate(F.sequence(F.lit(0), depth(block)), start, step)["all"]
    product = lambda n: F.coalesce(F.get_json_object(n, "$['@type']").rlike(r'(^|")Product($|")'), F.lit(False))                       # noqa: E731
    prices = lambda n: F.array_compact(F.array(*[fn_money(F.get_json_object(n, f"$.offers{at}.{p}")) for at in ("", "[0]") for p in ("price", "lowPrice")]))
    one = lambda b: F.flatten(F.transform(F.filter(nodes(b), lambda n: F.ltrim(n).startswith("{") & product(n)), prices))               # noqa: E731
    return F.get(F.flatten(F.transform(blocks, one)), 0)


def dq_store_page(deals: DataFrame, pages: DataFrame) -> DataFrame:
    """The store's product page shows the ad's price, or at least the regular price stated. Needs deals(url, price, regular),
    pages(url, html)."""
    c = F.col
    df = deals.join(pages.select("url", plain_page(F.col("html")).alias("_plain"), page_offer(F.col("html")).alias("page_price")), "url", "left")
    at = lambda v: F.coalesce(F.abs(c("page_price") - v) <= 0.011, F.lit(False)) | F.coalesce(has_price(c("_plain"), v), F.lit(False))
    good = at(c("price")) | at(c("regular"))
    return verdict(df, [("neither the ad's nor the regular price is on the page", ~good)],
                   [("no page", c("_plain").isNull()), ("a promotion without a price", c("price").isNull()), ("the page does not state a price", ~good & c("page_price").isNull())]).drop("_plain")


def dq_store_link(posts: DataFrame, stores: DataFrame) -> DataFrame:
    """A deal's link leads to the store shown, and a price read there matches or a condition explains it. Needs posts(id, link, store,
    price, qty, page_price, conditions), stores(store, domains). The link's host and its parents are looked up by equality."""
    c = F.col
    doms = stores.select(c("store").alias("_to"), F.explode("domains").alias("_d"))
    hosts = posts.select(fn_host(c("link")).alias("_h")).distinct().where("_h <> ''")
    labels = F.split("_h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    meant = hosts.select("_h", F.explode(suffixes).alias("_d")).join(doms, "_d").groupBy("_h").agg(F.max_by("_to", F.length("_d")).alias("_to"))
    df = posts.withColumn("_h", fn_host(c("link"))).join(meant, "_h", "left")
    unit = rounded(c("price") / F.greatest(F.coalesce(c("qty"), F.lit(1)), F.lit(1)), 2)
    known = F.array(*[F.lit(x) for x in ("coupon required", "promo code", "Subscribe & Save", "Prime members", "mail-in rebate", "discount applied in cart", "& more (price varies by option)",
                                         "price varies by size or color")])
    explained = F.arrays_overlap("conditions", known) & (c("page_price") > unit)
    return verdict(df, [("the link goes to a different store", (c("store") != "") & ~F.coalesce(c("_to") == c("store"), F.lit(False))),
                        ("another price at the store", off(c("page_price"), unit, F.greatest(F.lit(0.5), unit * 0.02)) & ~explained)], [("no link", c("_h") == "")]).drop("_h", "_to")


def dq_sale_page(sales: DataFrame, pages: DataFrame, today: Column) -> DataFrame:
    """A sale's page names the store, the figures and the code, and the end it states is the one shown. Needs sales(url, store_names, offer, code,
    posted date, end_day, ends_how), pages(url, html). A source's own end date may be a day off; an end that is over does not count against a
    sale that shows none."""
    c = F.col
    figures = F.array_distinct(F.regexp_extract_all(F.replace("offer", F.lit(","), F.lit("")), F.lit(r"(\$\d+|\d{1,3}%)"), F.lit(1)))
    df = sales.join(pages.select("url", plain_page(F.col("html")).alias("_text")), "url", "left").withColumn("_fig", figures)
    bare = F.replace("_text", F.lit(","), F.lit(""))
    code = F.coalesce(c("code"), F.lit(""))
    # every sentence is asked for its end, so a page may state several
    said = F.flatten(F.transform(F.split("_text", r"(?<=[.!?])\s+"), lambda x: F.array(stated_end(x, c("posted"))["last"], stated_range(x, c("posted"))["last"])))
    df = df.withColumn("_ends", F.filter(F.array_distinct(F.array_compact(said)), lambda d: d >= F.date_sub("posted", 1)))
    a_day_off = F.coalesce(c("ends_how"), F.lit("")).endswith("end date")
    agrees = F.exists("_ends", lambda d: (d == c("end_day")) | (a_day_off & (F.abs(F.datediff(d, c("end_day"))) <= 1)))
    later = F.exists("_ends", lambda d: d >= F.date_sub(today, 1))
    return verdict(df, [("the page doesn't name the store", ~F.exists("store_names", lambda n: F.lower("_text").contains(F.lower(n)))), ("a figure is not on the page", F.exists("_fig", lambda f: ~bare.contains(f))),
                        ("the page doesn't show the code", (code != "") & ~c("_text").contains(code)), ("shown after its end", F.coalesce(c("end_day") < today, F.lit(False))),
                        ("the page states an end that is not shown", c("end_day").isNull() & later), ("the page states a different end", c("end_day").isNotNull() & (F.size("_ends") > 0) & ~agrees)],
                   [("no page", c("_text").isNull())]).drop("_text", "_fig", "_ends")
