"""Filters that say why. Each returns its input with a `reason` column, null where the row is kept, so what is kept and
what is left out come from one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fn_fold, fn_host
from ..functions.amounts import bind, found
from ..functions.text import fn_clean, straight
from ..functions.times import days_between, seconds_between
from ..rules import wordings as R
from .wordwork import said, says, without

Rule = tuple[str, Column]


def first_reason(rules: Sequence[Rule]) -> Column:
    """The first rule that holds; a condition that is null does not hold."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for reason, holds in rules:
        chain = chain.when(holds, F.lit(reason))
    return chain


def flt_reason(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.withColumn("reason", first_reason(rules))


def kept(df: DataFrame) -> DataFrame:
    return df.where(F.col("reason").isNull()).drop("reason")


def flt_junk_item(items: DataFrame) -> DataFrame:
    """Entries of an ad that are no items. Needs name, display_type (1 is an item)."""
    name = fn_clean(F.col("name"))
    return flt_reason(items, [
        ("page element, not an item", F.coalesce(F.col("display_type"), F.lit(1)) != 1),
        ("no item name", name == ""),
        ("placeholder code, not an item", name.rlike(R.PLACEHOLDER_NAME) & ~name.contains(" ")),
        ("fine print, not an item", says(name, R.FINE_PRINT))])


def flt_window_overlap(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Valid at some moment of the closed window. Needs start_local, end_local and ends (the moment the source itself
    withdraws it)."""
    return flt_reason(df, [
        ("item already ended", F.least("end_local", "ends") < start),
        ("item starts after the window", F.col("start_local") > end)])


def flt_fresh_post(posts: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Posts still worth showing. Needs title, posted_at, expires_at, expires_stated."""
    ends = F.when(F.col("expires_stated"), F.col("expires_at"))
    fresh = F.col("posted_at") >= now - F.make_dt_interval(hours=F.lit(hours))
    return flt_reason(posts, [
        ("expired", F.coalesce(ends < now, F.lit(False)) | says(F.col("title"), R.OVER_TITLE)),
        (f"older than {hours} hours", ~(F.coalesce(fresh, F.lit(False)) | F.coalesce(ends > now, F.lit(False))))])


def flt_sale_live(sales: DataFrame, now: Column, posted_days: int = 30, undated_days: int = 7, ahead_days: int = 7) -> DataFrame:
    """Sales live at a moment. Needs starts_at, ends_at, posted_at."""
    day = 86400
    age = seconds_between(F.col("posted_at"), now)
    undated = F.col("ends_at").isNull() & F.coalesce(age > undated_days * day, F.lit(True))
    return flt_reason(sales, [
        ("sale: ended", F.col("ends_at") < now),
        (f"sale: posted over {posted_days} days ago", age > posted_days * day),
        (f"sale: no end date and posted over {undated_days} days ago", undated),
        (f"sale: starts after the next {ahead_days} days", seconds_between(now, F.col("starts_at")) > ahead_days * day)])


def flt_between_moments(df: DataFrame, now: Column) -> DataFrame:
    """Live between two moments, either of them open. Needs shown_from, shown_until."""
    return flt_reason(df, [("not yet", F.col("shown_from") > now), ("over", F.col("shown_until") < now)])


def flt_category_any(df: DataFrame, wanted: Sequence[str], reason: str = "other category") -> DataFrame:
    """Offers in any of the wanted categories. Needs categories (array)."""
    hit = F.arrays_overlap(F.col("categories"), F.array(*[F.lit(w) for w in wanted]).cast("array<string>"))
    return flt_reason(df, [(reason, ~F.coalesce(hit, F.lit(False)))])


def flt_not_sale(posts: DataFrame) -> DataFrame:
    """Why a post is no sale at a store that ships. Needs title, text, deal_type and the parsed offer columns pct, upto,
    extra, off, off_upto, min_spend, bogo, bogo_pct, buy_n, reward, as job_sale_offer gives them."""
    c = F.col
    # each form of the title is worked out once, with its lower case
    texts = (posts.withColumn("_title", straight(c("title"))).withColumns({"_main": without(c("_title"), R.ASIDE, ""), "_goods": without(c("_title"), R.SHIP_TAIL, "")})
             .withColumns({"_title_low": F.lower("_title"), "_main_low": F.lower("_main"), "_goods_low": F.lower("_goods")}))
    in_title, in_main, in_goods = (lambda rx, n=n: said(c(n), rx, c(n + "_low")) for n in ("_title", "_main", "_goods"))
    has = lambda c: F.col(c).isNotNull()                                                    # noqa: E731
    bogo = F.coalesce(F.col("bogo"), F.lit("")) != ""
    reward = F.coalesce(F.col("reward"), F.lit("")) != ""
    sale_type = F.coalesce(F.col("deal_type") == "sale", F.lit(False))
    sale_words, ceiling = in_main(R.SALE_WORDS), has("upto") | has("extra")
    wide = in_main(R.SITEWIDE) | in_main(R.EVERYTHING)
    order_size = F.coalesce(F.col("min_spend") > 0, F.lit(False))
    before_offer = r"^(.{3,}): (?=\s*(?i:up\s?to\b|extra\b|over\b|\d{1,3}\s?%|\$\d|bogo\b|buy\b|spend\b|save\b|take\b|at least\b))"
    head = F.coalesce(F.when(c("_title").contains(": "), found(c("_title"), before_offer)), c("_main"))
    head_names = bind(head, lambda h: says(h, R.SALE_WORDS) | says(h, R.CATEGORY_NOUNS) | says(h, R.SITEWIDE) | says(h, R.EVERYTHING))
    offer_text = F.coalesce(F.col("text"), F.lit(""))
    amounts = F.array_distinct(F.regexp_extract_all(offer_text, F.lit(r"\$\s?(\d[\d,]*(?:\.\d\d)?)"), F.lit(1)))
    many = (sale_type | sale_words | ceiling | order_size | wide | F.coalesce(F.col("buy_n") > 0, F.lit(False))
            | bogo | in_main(R.CATEGORY_NOUNS))
    one_price = in_main(R.ONE_PRICE) & ~in_main(R.PRICE_HEDGE)
    rules: list[Rule] = [("one product, not a sale", F.coalesce(F.col("deal_type") == "product", F.lit(False))),
                         ("a roundup of other deals", in_title(R.ROUNDUP))]
    rules += [(why, in_goods(rx) & ~(reward if why == "a gift card" else F.lit(False))) for rx, why in R.NOT_SALE]
    rules += [(why, in_title(rx)) for rx, why in R.NOT_SHIPPED]
    rules += [
        ("no discount stated", ~(has("pct") | ceiling | has("off") | has("bogo_pct") | bogo)),
        ("one product, not a sale", ~sale_type & ~sale_words & ~ceiling & (F.size(amounts) <= 2)
         & says(offer_text, r"\b(?:just|only|for)\s+\$\s?\d")),
        ("one product, not a sale", ~many | (one_price & ~ceiling & ~sale_type)),
        ("one product, not a sale", has("off") & ~has("pct") & ~ceiling & ~order_size & ~bogo
         & ~F.coalesce(F.col("off_upto"), F.lit(False)) & ~head_names)]
    return flt_reason(texts, rules).select(*posts.columns, "reason")


def flt_not_promo(posts: DataFrame) -> DataFrame:
    return flt_reason(posts, [("promotion: gift card, subscription, game or merchandise", says(F.col("title"), R.NOT_A_PROMO))])


def flt_storewide(posts: DataFrame) -> DataFrame:
    return flt_reason(posts, [("storewide sale or many products", says(F.col("title"), R.STOREWIDE))])


def flt_min_saving(items: DataFrame, lo: float = 10.0, hi: float = 95.0) -> DataFrame:
    return flt_reason(items, [("saving too small", F.coalesce(F.col("pct") < lo, F.lit(True))),
                              ("saving not believable", F.col("pct") >= hi)])


def flt_implausible(items: DataFrame, pct: float = 90.0) -> DataFrame:
    """A saving this big, measured against anything but a firm regular price, is an error. Needs pct, basis."""
    return flt_reason(items, [("implausible saving", (F.col("pct") >= pct) & (F.col("basis") != "store_regular"))])


def flt_placeholder_expiry(posts: DataFrame, days: Sequence[int] = R.PLACEHOLDER_DAYS) -> DataFrame:
    """Expiries a feed makes up: a fixed number of days after posting, give or take a clock change."""
    took = seconds_between(F.col("posted_at"), F.col("expires_at"))
    made_up = F.exists(F.array(*[F.lit(float(n * 86400 + shift)) for n in days for shift in (0, 3600, -3600)]),
                       lambda s: F.abs(took - s) < 120)
    return flt_reason(posts, [("no expiry", F.col("expires_at").isNull()), ("placeholder expiry", made_up)])


def is_product_link(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return u.startswith("http") & ~(says(u, R.LANDING_PAGE) & ~says(u, R.PRODUCT_PATH)) & says(u, R.PRODUCT_PAGE)


def flt_product_link(df: DataFrame) -> DataFrame:
    return flt_reason(df, [("no product page", ~is_product_link(F.col("url")))])


def flt_foreign_host(sites: DataFrame, covered: DataFrame) -> DataFrame:
    """Sites that are not a shop's own, or are read elsewhere. Needs url; `covered` has domain. A host is covered by its
    own name or any parent domain, so each distinct host is tried under its suffixes."""
    hosts = sites.select(fn_host(F.col("url")).alias("host")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    under = (hosts.where("host <> ''").select("host", F.explode(suffixes).alias("domain"))
             .join(covered.select("domain").distinct(), "domain", "left_semi")
             .select(F.col("host").alias("_host")).distinct().withColumn("_covered", F.lit(True)))
    df = sites.withColumn("_host", fn_host(F.col("url"))).join(under, "_host", "left")
    return flt_reason(df, [("no site", F.col("_host") == ""), ("not a shop's own site", says(F.col("_host"), R.FOREIGN_HOST)),
                           ("read elsewhere", F.col("_covered"))]).drop("_host", "_covered")


def flt_own_site(sites: DataFrame) -> DataFrame:
    """A shop's address carries its name, run together or by a word of four letters or more. Needs host, name."""
    parts = F.split("host", r"\.")
    labels = F.filter(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
                                  lambda x: F.struct(F.replace(x, F.lit("-"), F.lit("")).alias("lab"), x.alias("raw"))),
                      lambda x: ~x["raw"].isin(*R.GENERIC_LABELS))
    whole = fn_fold(F.col("name"))
    words = F.filter(F.regexp_extract_all(F.lower(F.replace("name", F.lit("&"), F.lit(" and "))), F.lit(r"([a-z0-9]+)"), F.lit(1)),
                     lambda w: (F.length(w) >= 4) & ~w.isin(*R.NAME_FILLER))
    carries = F.exists(labels, lambda x: (whole != "") & ((whole == x["lab"]) | ((F.length(whole) >= 4) & (
        x["lab"].contains(whole) | whole.contains(x["lab"])))) | F.exists(words, lambda w: x["lab"].contains(w)))
    return flt_reason(sites, [("not the shop's own address", ~F.coalesce(carries, F.lit(False)))])


def flt_stale_answer(answers: DataFrame, items: DataFrame, expected: DataFrame, now: Column) -> DataFrame:
    """Stored answers to read again. `answers` has answer, read_at; `items` answer, ad, ends; `expected` answer, ad.
    An end that came since the read exists exactly when the latest end before `now` is one."""
    missing = (expected.select("answer", "ad").distinct()
               .join(items.select("answer", "ad").distinct(), ["answer", "ad"], "left_anti")
               .select("answer").distinct().withColumn("_missing", F.lit(True)))
    ended = items.groupBy("answer").agg(F.max(F.when(F.col("ends") < now, F.col("ends"))).alias("_ended"))
    return flt_reason(answers.join(missing, "answer", "left").join(ended, "answer", "left"),
                      [("misses an ad expected there", F.col("_missing")),
                       ("holds items that ended since", F.col("_ended") > F.col("read_at"))]).drop("_missing", "_ended")


def prj_coalesce_sources(listing: DataFrame, hit: DataFrame, on: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The listing's fields where it has them, the search hit's where it hasn't."""
    h = hit.select(*on, *[F.col(f).alias(f"_hit_{f}") for f in fields])
    own = [F.col(c) for c in listing.columns if c not in fields]
    return (listing.join(h, list(on), "left")
            .select(*own, *[F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_hit_{f}")).alias(f) for f in fields]))


def prj_kind(df: DataFrame) -> DataFrame:
    """regular, promotion or deal. Needs is_regular, promo, hedge, bogo."""
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""                                    # noqa: E731
    return df.withColumn("kind", F.when(F.col("is_regular"), "regular")
                         .when(F.coalesce(F.col("promo"), F.lit(False)) | said("hedge") | said("bogo"), "promotion")
                         .otherwise("deal"))


def prj_day_labels(df: DataFrame, now: Column, zone: Column) -> DataFrame:
    """Calendar days until an offer starts (not below 0) and ends. Needs valid_from, valid_to."""
    return df.withColumns({
        "starts_in_days": F.greatest(F.lit(0), days_between(now, F.col("valid_from"), zone)),
        "ends_in_days": days_between(now, F.col("valid_to"), zone)})


def flt_partition_lists(df: DataFrame) -> DataFrame:
    """Which list a kept deal is shown in. Needs store_status, kind."""
    return df.withColumn("list", F.when(F.col("store_status") == "unmapped", "unconfirmed")
                         .when(F.col("kind") == "promotion", "promotions")
                         .when(F.col("store_status") == "nearby", "deals"))
