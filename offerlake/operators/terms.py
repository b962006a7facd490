"""Ad items and posts read as terms: price, what it is measured against, and how firm that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entities import fn_unescape
from ..functions import fn_money, fn_pct, fn_summary
from ..functions.amounts import AMOUNT, bind, dollars, general, number, rounded
from ..functions.text import fn_clean
from ..rules import wordings as R
from .wordwork import bogo_of, ci, first_label, got, got_number, labels_of, matches, says, staged

TERMS = ["price", "regular", "savings", "pct", "basis", "qty", "bundle_price", "bogo", "hedge", "unit", "conditions", "promo", "summary", "rejected"]


def hedge_of(text: Column) -> Column:
    return F.coalesce(first_label(text, R.HEDGES), F.lit(""))


def conditions_of(text: Column) -> Column:
    limit = got(text, R.LIMIT)
    return F.array_compact(F.concat(labels_of(text, R.CONDITIONS), F.array(
        F.when(limit.isNotNull(), F.concat(F.lit("limit "), limit)), F.when(says(text, R.CASE_ONLY), F.lit("full case only")))))


def job_hedges_conditions(texts: DataFrame) -> DataFrame:
    """The hedge and the conditions a text states. Needs text."""
    return texts.withColumns({"hedge": hedge_of(F.col("text")), "conditions": conditions_of(F.col("text"))})


def job_ad_terms(items: DataFrame) -> DataFrame:
    """The terms of weekly-ad items as a struct `terms`. Needs name, pre_price_text, price_text, sale_story, description,
    disclaimer_text, price, original_price, dollars_off, percent_off, in_store_only, membership and feed (the item comes
    from the retailer's own product feed, so savings are measured from its regular price)."""
    c = F.col
    join = lambda *xs: F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in xs])                  # noqa: E731
    off_here = c("_post").rlike(r"(?i)^(?:%\s*)?off\b") & c("_price").isNotNull() & c("_original").isNull()
    as_money, as_pct = off_here & ~c("_post").startswith("%"), off_here & c("_post").startswith("%") & (c("_price") <= 100)
    qty_pre = got_number(c("_pre"), R.MULTI_PREFIX).cast("int")
    multi_text = c("_multi_text")
    qty_text = got_number(multi_text, R.MULTI_TEXT, 1).cast("int")
    coupon = fn_money(got(join(c("_pre"), c("_post")), R.COUPON_OFF))
    listed, text_reg = fn_money(got(c("_all"), R.LIST)), fn_money(got(c("_all"), R.REGULAR))
    firm, list_words = says(c("_all"), R.FIRM_WORDS), says(c("_all"), R.LIST_WORDS)
    by_feed = F.when(c("feed"), "store_regular").otherwise("claimed_savings")
    promo_text = c("_promo_text")
    unit = lambda t: F.lower(got(t, R.UNIT))                                                    # noqa: E731

    df = items.withColumns({
        "_name": fn_clean(c("name")), "_pre": fn_clean(c("pre_price_text")), "_post": fn_clean(c("price_text")),
        "_story": fn_clean(c("sale_story")), "_desc": fn_clean(c("description")), "_fine": fn_clean(c("disclaimer_text")),
        "_price": fn_money(c("price")), "_original": fn_money(c("original_price")), "_dollars": fn_money(c("dollars_off")),
        "_percent": F.when(c("percent_off") > 0, c("percent_off").cast("double"))})
    df = df.withColumns({"_promo_text": join(c("_story"), c("_name"), c("_pre"), c("_post")), "_multi_text": join(c("_story"), c("_name")),
                         "_hedge_text": join(c("_pre"), c("_post"), c("_story"), c("_name")),
                         "_cond_text": join(c("_name"), c("_pre"), c("_post"), c("_story"), c("_fine"), c("_desc"))})
    df = df.withColumns({"_all": join(c("_name"), c("_pre"), c("_post"), c("_story"), c("_fine")), "_as_money": F.coalesce(as_money, F.lit(False)),
                         "_as_pct": F.coalesce(as_pct, F.lit(False)), "_qty_pre": qty_pre, "_qty_text": qty_text})
    df = df.withColumns({"_p1": F.when(~c("_as_money") & ~c("_as_pct"), c("_price")), "_promo0": c("_as_money") | c("_as_pct")})
    by_pre, by_text = c("_p1").isNotNull() & (c("_qty_pre") > 1), c("_p1").isNull() & (c("_qty_text") > 1)
    df = df.withColumns({"qty": F.when(by_pre, c("_qty_pre")).when(by_text, c("_qty_text")).otherwise(1),
                         "bundle_price": F.when(by_pre, c("_p1")).when(by_text, fn_money(got(multi_text, R.MULTI_TEXT, 2)))})
    df = df.withColumn("_p2", F.when(c("bundle_price").isNotNull(), rounded(c("bundle_price") / c("qty"), 2)).otherwise(c("_p1")))
    df = df.withColumn("_coupon", F.when(c("_p2").isNotNull() & (c("qty") == 1) & c("_original").isNull() & c("_dollars").isNull() & (coupon < c("_p2")), coupon))
    df = df.withColumns({"_p": F.when(c("_coupon").isNotNull(), rounded(c("_p2") - c("_coupon"), 2)).otherwise(c("_p2")),
                         "_dollars": F.coalesce("_coupon", "_dollars"), "_bogo": bogo_of(promo_text)})
    df = df.withColumns({"_firm": firm, "_list_words": list_words, "_text_reg": text_reg, "_listed": listed,
                         "_all_list": says(c("_all"), R.LIST), "_pct_said": got_number(promo_text, R.PCT_OFF),
                         "_off_said": F.coalesce(got_number(promo_text, R.DOLLARS_OFF, 1), got_number(promo_text, R.DOLLARS_OFF, 2)),
                         "unit": F.coalesce(unit(c("_post")), unit(c("_pre")), F.lit(""))})
    df = df.withColumn("unit", F.when(c("unit") == "lbs", "lb").when(c("unit") == "each", "ea").otherwise(c("unit")))
    # the reference, strongest evidence first; each way carries its basis
    ways = F.coalesce(
        F.when(c("_text_reg").isNotNull() & (c("qty") == 1), F.struct(c("_text_reg").alias("r"), F.lit("store_regular").alias("b"), F.lit(1).alias("w"))),
        F.when(c("_original") > c("_p"), F.struct(c("_original").alias("r"), F.when(c("_list_words") & ~c("_firm"), "list")
                                                   .when(c("feed") | c("_firm"), "store_regular").otherwise("claimed_savings").alias("b"), F.lit(2).alias("w"))),
        F.when((c("_dollars") > 0) & c("_p").isNotNull(), F.struct(rounded(c("_p") + c("_dollars"), 2).alias("r"), by_feed.alias("b"), F.lit(3).alias("w"))),
        F.when((c("_percent") < 100) & c("_p").isNotNull(), F.struct(F.lit(None).cast("double").alias("r"), by_feed.alias("b"), F.lit(4).alias("w"))),
        F.when(c("_listed") > c("_p"), F.struct(c("_listed").alias("r"), F.lit("list").alias("b"), F.lit(5).alias("w"))))
    df = df.withColumn("_way", ways)
    df = df.withColumns({"_r": c("_way.r"), "_b": F.when(c("_all_list") & (c("_way.b") == "claimed_savings") & (c("_way.w") != 4), "list").otherwise(c("_way.b")),
                         "_headline": F.coalesce(c("_way.w") == 4, F.lit(False)), "_is_bogo": c("_bogo.label").isNotNull(),
                         "_open": c("_p").isNull() & ~c("_promo0")})
    whole_case = c("unit").isin("lb", "oz", "kg") & (c("_r") / c("_p") > 8)
    df = df.withColumn("_ok", ~c("_is_bogo") & ~c("_headline") & ~c("_open") & ~c("_promo0") & F.coalesce((c("_r") > c("_p")) & ~whole_case, F.lit(False)))
    df = df.withColumn("_pct", F.when(c("_ok"), fn_pct(c("_p"), c("_r"))))
    df = df.withColumn("_bad", F.coalesce(c("_ok") & (c("_pct") >= 90) & (c("_b") != "store_regular"), F.lit(False)))
    said_pct = F.coalesce("_pct_said", F.when(c("_off_said").isNull(), c("_percent")))
    df = df.withColumn("_open_promo", c("_open") & (said_pct.isNotNull() | c("_off_said").isNotNull()))
    good = c("_ok") & ~c("_bad")
    df = df.withColumns({
        "_hedge": hedge_of(c("_hedge_text")), "_cond0": conditions_of(c("_cond_text"))})
    extra = F.array_compact(F.array(F.when(F.coalesce(c("in_store_only"), F.lit(False)) & ~F.array_contains("_cond0", "in store only"), F.lit("in store only")),
                                    F.nullif(c("membership"), F.lit(""))))
    terms = {
        "price": F.when(~c("_promo0"), c("_p")),
        "regular": F.when(c("_is_bogo") & c("_p").isNotNull(), c("_p")).when(good, c("_r")),
        "savings": F.when(c("_as_money") & ~c("_is_bogo"), c("_price")).when(c("_is_bogo"), rounded(c("_p") * c("_bogo.pct") / 100, 2))
        .when(good, rounded(c("_r") - c("_p"), 2)).when(c("_open") & c("_pct_said").isNull(), c("_off_said")),
        "pct": F.when(c("_is_bogo"), c("_bogo.pct")).when(c("_as_pct"), c("_price")).when(c("_headline"), c("_percent"))
        .when(c("_open"), said_pct).when(good, c("_pct")),
        "basis": F.when(c("_is_bogo"), "store_regular").when(c("_headline"), c("_b"))
        .when(c("_open_promo"), F.when(c("feed") | c("_firm"), "store_regular").otherwise("claimed_savings")).when(good, c("_b")).otherwise("none"),
        "qty": c("qty"), "bundle_price": c("bundle_price"), "bogo": F.coalesce("_bogo.label", F.lit("")), "hedge": c("_hedge"), "unit": c("unit"),
        "conditions": F.concat("_cond0", extra), "promo": c("_promo0") | c("_is_bogo") | c("_open_promo"),
        "rejected": F.when(c("_bad"), F.concat(general(c("_pct")), F.lit("% off a "), dollars(c("_r")), F.lit(" price: likely an ad error"))).otherwise("")}
    df = df.withColumn("_t", F.struct(*[v.alias(k) for k, v in terms.items()]))
    full = F.struct(*[fn_summary(c("_t")).alias(k) if k == "summary" else c(f"_t.{k}").alias(k) for k in TERMS])
    return df.select(*items.columns, full.alias("terms"))


# --- posts ---

def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z*\"'(])")


def quoted(text: Column, pattern: str) -> Column:
    """The sentence a wording stands in, or the wording itself where it runs over a sentence's end."""
    return F.coalesce(F.get(F.filter(sentences(text), lambda s: s.rlike(ci(pattern))), 0), got(text, pattern, 0))


def post_reference(text: Column, price: Column) -> Column:
    """What a post measures its price against: struct(ref, basis, quote), the most telling wording first."""
    def way(ok: Column, ref: Column, basis: str, pattern: str) -> Column:
        return F.when(ok, F.struct(ref.cast("double").alias("ref"), F.lit(basis).alias("basis"), quoted(text, pattern).alias("quote")))

    def amount(pattern: str, g: int = 1) -> Column:
        return fn_money(got(text, pattern, g))

    near = lambda v: F.abs(v - price) <= F.greatest(F.lit(1.0), price * 0.02)                    # noqa: E731
    on_top = lambda rx, basis: way(amount(rx) > 0, rounded(price + amount(rx), 2), basis, rx)       # noqa: E731
    above = lambda rx, basis, g=1: way(amount(rx, g) > price, amount(rx, g), basis, rx)             # noqa: E731
    chain = lambda rx: way(near(amount(rx, 2)) & (amount(rx, 1) > price), amount(rx, 1), "store_regular", rx)
    return F.coalesce(
        way((amount(R.FROM_TO) > 0) & near(amount(R.FROM_TO, 2)), amount(R.FROM_TO), "store_regular", R.FROM_TO),
        on_top(R.MORE_AT, "editor_compare"), above(R.ELSEWHERE, "editor_compare"), above(R.MOST_CHARGE, "editor_compare"),
        on_top(R.BEST_BY, "editor_compare"), above(R.OFF_LIST, "list", 2), chain(R.CHAIN), chain(R.CODE_CHAIN),
        above(R.REGULAR, "store_regular"), above(R.USUAL, "store_regular"), above(R.DOWN_FROM, "store_regular"), above(R.REG_AFTER, "store_regular"),
        on_top(R.LOW, "history"), on_top(R.A_SAVING, "list"), on_top(R.THATS_OFF, "list"), on_top(R.UNDER_LIST, "list"), above(R.LIST_OF, "list"),
        way(says(text, R.HISTORY), F.lit(None), "history", R.HISTORY),
        F.struct(F.lit(None).cast("double").alias("ref"), F.lit("none").alias("basis"), F.lit("").alias("quote")))


def title_price(title: Column) -> Column:
    """The first amount of a title that is a price."""
    either = f"(?:{R.PRICE_IN_TITLE})|(?:{R.CENTS_IN_TITLE})"
    found = F.transform(matches(title, either), lambda m: F.coalesce(
        fn_money(F.nullif(F.regexp_extract(m, r"\$\s?([\d.,]+)", 1), F.lit(""))),
        F.regexp_extract(m, r"^(\d{1,2})", 1).try_cast("double") / 100))
    return F.get(F.filter(found, lambda p: p > 0), 0)


def job_post_price_reference(posts: DataFrame) -> DataFrame:
    """A post's exact price, what it is measured against and the words for that. Needs title, text, price, reference,
    pct_stated. Adds deal_price, reference_price, basis, basis_text, pct, qty, hedge and conditions."""
    c = F.col
    text = fn_clean(c("text"))
    exact = F.get(F.filter(F.transform(matches(c("_text"), R.EXACT), lambda m: number(F.regexp_extract(m, ci(R.EXACT), 1))),
                           lambda v: (F.abs(v - c("_p0")) < 1.0) & (v != c("_p0"))), 0)
    many, of = got_number(c("title"), R.MULTI_BUY, 1), got_number(c("title"), R.MULTI_BUY, 2)
    from_pct = rounded(c("deal_price") / (1 - c("pct_stated") / 100), 2)
    s = lambda ref, basis, words: F.struct(ref.alias("ref"), F.lit(basis).alias("basis"), words.alias("quote"))
    said = (F.when(c("reference") > c("deal_price"), s(c("reference"), "store_regular", F.concat(F.lit("Reg. "), dollars(c("reference")))))
            .when((c("pct_stated") > 0) & (c("pct_stated") < 100), s(from_pct, "store_regular", F.concat(general(c("pct_stated")), F.lit("% off"))))
            .when(c("deal_price").isNotNull(), bind(F.struct(c("_text").alias("t"), c("deal_price").alias("p")), lambda x: post_reference(x["t"], x["p"]))))
    better = c("_ref.ref") > c("deal_price")
    hedged = F.array_compact(F.array(F.nullif(c("hedge"), F.lit("")),
                                     F.when(c("qty") > 1, F.concat(F.lit("price is for "), c("qty").cast("string"), F.lit(" ("),
                                                                   dollars(c("deal_price") / c("qty")), F.lit(" each)")))))
    return staged(
        posts, ["deal_price", "reference_price", "basis", "basis_text", "pct", "qty", "hedge", "conditions"],
        {"_text": text, "_p0": F.coalesce(F.nullif(c("price"), F.lit(0.0)), title_price(c("title")))},
        {"deal_price": F.coalesce(exact, c("_p0")), "hedge": hedge_of(c("title"))},
        {"qty": F.when((many > 1) & (F.abs(of - c("deal_price")) < 1), many.cast("int")).otherwise(1), "_ref": said},
        {"reference_price": F.when(better, c("_ref.ref")), "basis_text": F.coalesce("_ref.quote", F.lit("")),
         "basis": F.when(better, c("_ref.basis")).when(c("_ref.basis") == "history", "history").otherwise("none"),
         "pct": fn_pct(c("deal_price"), c("_ref.ref")),
         "conditions": F.concat(conditions_of(F.concat_ws(" ", "title", "_text")), hedged)})


def job_price_pair(posts: DataFrame) -> DataFrame:
    """For titles that state only the saving: the two amounts of the text that agree with it best. Needs title, text. Adds
    pair_price and pair_reference."""
    c = F.col
    amounts = F.array_compact(F.array_distinct(F.transform(matches(c("text"), r"\$\s?" + AMOUNT), fn_money)))
    saving = fn_money(F.coalesce(got(c("title"), R.TITLE_SAVING, 1), got(c("title"), R.TITLE_SAVING, 2)))
    percent = got_number(c("title"), R.TITLE_PCT)

    def err(p: Column, r: Column) -> Column:
        return (F.when(c("_saving").isNotNull(), F.abs(r - p - c("_saving")) / F.greatest(F.lit(1.0), c("_saving") * 0.02))
                .otherwise(F.abs((1 - p / r) * 100 - c("_percent")) / 1.5))
    pairs = F.flatten(F.transform(c("_a"), lambda p, i: F.transform(F.filter(c("_a"), lambda r: r > p), lambda r, j: F.struct(
        err(p, r).alias("err"), i.alias("i"), j.alias("j"), p.alias("p"), r.alias("r")))))
    return staged(posts, ["pair_price", "pair_reference"],
                  {"_a": amounts, "_saving": saving, "_percent": percent},
                  {"_best": F.array_min(F.filter(pairs, lambda x: x["err"] <= 1))},
                  {"pair_price": c("_best.p"), "pair_reference": c("_best.r")})


def job_post_seller(posts: DataFrame) -> DataFrame:
    """The store a post is for: a bracketed domain, "via X", "X has", a link, "at X". Needs title, text. Adds seller_said:
    a domain or a name."""
    t = F.coalesce(F.col("text"), F.lit(""))
    x = lambda col, rx: F.nullif(F.trim(F.regexp_extract(col, rx, 1)), F.lit(""))                   # noqa: E731
    return posts.withColumn("seller_said", F.coalesce(
        x(t, r"\[\s*((?:[a-z0-9-]+\.)+[a-z]{2,})\s*\]"), x(t, r"\bvia ([A-Z][\w&'.!\- ]{1,30}?)(?: \[| has| offers| is\b|[.,])"),
        x(t, r"(?:^|[.!] )([A-Z][\w&'.!\-]*(?: [A-Z][\w&'.!\-]*){0,3}) (?:has|offers|is offering|is selling)\b"),
        x(t, r"https?://(?:www\.)?((?:[a-z0-9-]+\.)+[a-z]{2,})/"), x(F.col("title"), r"\bat ([A-Z][\w&'.\- ]{1,30})$"), F.lit("")))


TITLE_STOP = "for with and the free shipping shipped only just deal off via from".split()


def plain_page(html: Column) -> Column:
    """A page's text without its tags, character references decoded."""
    return F.trim(F.regexp_replace(fn_unescape(F.regexp_replace(html, r"<[^>]+>", " ")), r"[\s\u00a0]+", " "))


def title_words(title: Column) -> Column:
    t = F.regexp_replace(F.lower(title), r"\$[\d,.]+", " ")
    return F.filter(F.regexp_extract_all(t, F.lit(r"([a-z0-9]{3,})"), F.lit(1)), lambda w: ~w.isin(*TITLE_STOP))


def job_post_gone(posts: DataFrame, pages: DataFrame) -> DataFrame:
    """Why a post's page shows its deal is over: moved elsewhere, to a store's list, marked, or without the title's words.
    Needs posts(url, title), pages(url, final_url, html); a post without a page keeps a null `gone`."""
    path = lambda u: F.regexp_replace(F.coalesce(F.parse_url(u, F.lit("PATH")), F.lit("")), "/+$", "")            # noqa: E731
    df = posts.join(pages.select("url", "final_url", "html"), "url", "left").withColumns(
        {"_plain": plain_page(F.col("html")), "_w": title_words(F.col("title")), "_from": path(F.col("url")),
         "_to": path(F.coalesce("final_url", "url"))})
    low = F.lower("_plain")
    share = F.size(F.filter("_w", lambda w: low.contains(w))) / F.size("_w")
    why = (F.when((F.col("_to") != F.col("_from")) & ~F.col("_to").startswith(F.col("_from")), "the post was removed (redirects elsewhere)")
           .when(F.col("url").contains("dealnews.com") & F.col("_to").rlike(r"^/s\d+/"),
                 "the post was removed (the link now goes to the store's listing page)")
           .when(says(F.col("_plain"), R.EXPIRED_MARK), "the post is marked expired")
           .when((F.size("_w") >= 3) & (share < 0.5), "the post page no longer shows this deal"))
    return df.withColumn("gone", F.when(F.col("html").isNotNull(), F.coalesce(why, F.lit("")))).drop("_plain", "_w", "_from", "_to", "html", "final_url")


def job_site_platform(pages: DataFrame) -> DataFrame:
    """Which shop platform a page runs on. Needs html."""
    return pages.withColumn("platform", F.coalesce(first_label(F.col("html"), R.PLATFORMS), F.lit("")))


def job_current_roundup_page(sitemap: DataFrame, wanted: DataFrame, today: Column, fresh_days: int = 45) -> DataFrame:
    """The current page for each weekday page that moved: it names the day and no other, is about restaurants' deals, is
    fresh, and shares the most words with the old address. Needs sitemap(site, url, modified), wanted(site, day, old_url)."""
    words = lambda u: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.parse_url(u, F.lit("PATH")), F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))
    days = F.array(*[F.lit(d) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")])
    any_of = lambda *ws: F.arrays_overlap(F.col("words"), F.array(*[F.lit(w) for w in ws]))          # noqa: E731
    p = (sitemap.where(F.datediff(today, "modified") <= fresh_days).withColumn("words", words(F.col("url")))
         .withColumn("_days", F.array_intersect("words", days))
         .where((F.size("_days") == 1) & any_of("restaurant", "restaurants", "food", "meal", "meals") & any_of("deal", "deals", "special", "specials"))
         .withColumn("day", F.array_position(days, F.get("_days", 0)) - 1))
    pairs = p.join(wanted.withColumn("_like", words(F.col("old_url"))), ["site", "day"])
    best = pairs.groupBy("site", "day").agg(F.max(F.struct(F.size(F.array_intersect("words", "_like")).alias("n"), "modified", "url")).alias("b"))
    return best.select("site", "day", "b.url", "b.modified")
