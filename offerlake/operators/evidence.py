"""Whether a page still states a standing offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fn_nearest_year, fn_tidy
from ..functions.amounts import bind
from ..functions.text import positions
from ..functions.times import month_number
from ..rules import standing as S
from .quality import verdict
from .wordwork import got, matches, says

def none() -> Column:
    return F.array().cast("array<string>")



def plain(html: Column) -> Column:
    """A page's words in lower case, with straight quotes."""
    return F.translate(F.lower(fn_tidy(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " "), r"<[^>]+>", " "))), "\u2019\u2018", "''")


def offer_facts(offer: Column, bogo: Column) -> Column:
    """What a card claims, as a struct: amounts, percents, half, bogo."""
    t = F.lower(fn_tidy(F.coalesce(offer, F.lit(""))))
    all_ = lambda rx: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(rx), F.lit(0))))
    return F.struct(all_(r"\$\d+(?:\.\d{2})?").alias("amounts"), all_(r"\d{1,2}%").alias("percents"), says(t, r"\bhalf[- ]?(?:priced?|off)\b|\b1/2[- ]?(?:priced?|off)\b").alias("half"),
                    (F.coalesce(bogo, F.lit(False)) | says(t, r"\bbogo\b|\bbuy one\b")).alias("bogo"))


def lacks(passage: Column, facts: Column) -> Column:
    """How many of the claims a passage does not have. "$6" is not "$6.75", but "$1" is "$1.00"."""
    amount = lambda a: F.rlike(passage, F.concat(F.lit("\\Q"), a, F.lit("\\E(?:\\.00)?(?!\\d|\\.\\d)")))
    percent = lambda p: F.contains(passage, p) | ((p == "50%") & passage.rlike(S.SAYS_HALF))
    return (F.size(F.filter(facts["amounts"], lambda a: ~amount(a))) + F.size(F.filter(facts["percents"], lambda p: ~percent(p)))
            + (facts["half"] & ~passage.rlike(S.SAYS_HALF)).cast("int") + (facts["bogo"] & ~passage.rlike(S.SAYS_BOGO)).cast("int"))


def passages(text: Column, needles: Column, before: int, after: int) -> Column:
    """The text around the needles. Around each place where one stands there is an interval; intervals that overlap are one, so all passages
    together are no longer than the text."""
    spans = F.array_sort(F.flatten(F.transform(needles, lambda n: F.transform(positions(text, n), lambda at: F.struct(
        F.greatest(at - before, F.lit(0)).cast("int").alias("a"), (at + F.length(n) + after).cast("int").alias("b"))))))
    last = lambda acc: F.element_at(acc, -1)
    sweep = lambda acc, x: (F.when((F.size(acc) > 0) & (x["a"] <= last(acc)["b"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], x["b"]).alias("b")))))
                            .otherwise(F.array_append(acc, x)))
    merged = bind(spans, lambda s: F.when(F.size(s) == 0, s).otherwise(F.aggregate(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 1, 1), sweep)))
    return F.transform(merged, lambda x: F.substring(text, x["a"] + 1, x["b"] - x["a"]))


def name_keys(brand: Column, loose: bool = False) -> Column:
    """How a page may spell a name: in full, without apostrophes, hyphens or points, and by its first telling word (`loose`: also a short one)."""
    b = F.translate(F.lower(fn_tidy(brand)), "\u2019\u2018", "''")
    word = F.get(F.filter(F.regexp_extract_all(F.replace(b, F.lit("."), F.lit("")), F.lit(r"([a-z0-9']+)"), F.lit(1)), lambda w: ~w.isin(*S.GENERIC_NAMES)), 0)
    keys = F.array(b, F.replace(b, F.lit("'"), F.lit("")), F.replace(b, F.lit("-"), F.lit(" ")), F.replace(b, F.lit("."), F.lit("")), F.when(F.length(word) >= (3 if loose else 5), word))
    return F.array_distinct(F.filter(F.array_compact(keys), lambda k: F.length(k) >= 3))


def entries(html: Column, brand: Column) -> Column:
    """A chain's own entries on a list page: list items that begin with its name and a colon, and sections under a heading with its name."""
    body = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")

    def of(keys: Column) -> Column:
        named = lambda head: F.exists(keys, lambda k: F.contains(head, k))
        items = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1)), plain)
        own = F.filter(items, lambda x: bind(F.substring(x, 1, 80), lambda head: F.contains(head, F.lit(":")) & named(F.substring_index(head, ":", 1))))
        secs = F.transform(F.filter(F.slice(F.split(body, r"(?i)<h2[^>]*>"), 2, 100_000), lambda x: F.contains(x, F.lit("</h2>"))), lambda x: F.struct(
            plain(F.substring_index(x, "</h2>", 1)).alias("head"), plain(F.regexp_replace(x, r"(?s)^.*?</h2>", "")).alias("rest")))
        under = F.transform(F.filter(secs, lambda x: named(x["head"])), lambda x: F.concat(x["head"], F.lit(": "), F.substring(x["rest"], 1, 3000)))
        return F.concat(own, under)
    return bind(name_keys(brand, loose=True), of)


def ended(passage: Column, today: Column) -> Column:
    """Whether the last end a passage states is over."""
    def day(m: Column) -> Column:
        g = lambda i: F.nullif(F.regexp_extract(m, S.PASSAGE_ENDS, i), F.lit(""))
        month, date = month_number(g(1)), g(2).try_cast("int")
        return F.when(g(3).isNotNull(), F.try_to_date(F.format_string("%04d-%02d-%02d", g(3).try_cast("int"), month, date))).otherwise(fn_nearest_year(month, date, today))
    return F.coalesce(F.array_max(F.transform(matches(passage, S.PASSAGE_ENDS), day)) < today, F.lit(False))


def over(entry: Column, facts: Column, today: Column) -> Column:
    """Whether the entry's sentence about the offer states an end that has passed."""
    some = F.struct(facts["amounts"].alias("amounts"), facts["percents"].alias("percents"), F.lit(False).alias("half"), F.lit(False).alias("bogo"))
    said = F.filter(F.split(entry, r"(?<=[.!?])\s+"), lambda x: F.length(F.trim(x)) > 12)
    return bind(said, lambda ss: F.exists(ss, lambda x: ((F.size(ss) == 1) | (lacks(x, some) == 0)) & ended(x, today)))


def dq_evidence_page(offers: DataFrame, pages: DataFrame, today: Column) -> DataFrame:
    """Whether an offer's evidence page, read now, states the chain, a day it runs on and every amount, percent, buy-one-get-one and half price
    of its card. Needs offers(id, url, kind, brand, offer, bogo, day_words), pages(url, html); `kind` is "list", "article" or a company's own page.

    A list must be for one of the days and have an entry of the chain with all claims and no end that has passed. On other pages claims and a day
    must stand in one passage: around the place's name in an article, else around the claims; a page that names one schedule only may
    give its day anywhere. An offer that claims nothing is inconclusive."""
    c = F.col
    df = offers.join(pages.select("url", c("html").alias("_html"), plain(c("html")).alias("_text")), "url", "left").withColumn("_f", offer_facts(c("offer"), c("bogo")))
    is_list, article = c("kind") == "list", c("kind") == "article"
    has_day = lambda x: F.exists("day_words", lambda d: F.contains(x, d))
    head = plain(F.concat_ws(" ", got(c("_html"), r"(?s)<title[^>]*>(.*?)</title>", 1), got(c("_html"), r"(?s)<h1[^>]*>(.*?)</h1>", 1)))
    names = F.filter("day_words", lambda d: d.isin(*S.WEEKDAYS))
    df = df.withColumn("_entries", F.when(is_list, entries(c("_html"), c("brand"))))
    df = df.withColumn("_good", F.filter("_entries", lambda x: lacks(x, c("_f")) == 0))
    anchors = F.concat("_f.amounts", "_f.percents", F.when(c("_f.bogo"), F.array(F.lit("bogo"), F.lit("buy one"))).otherwise(none()), F.when(c("_f.half"), F.array(F.lit("half"), F.lit("1/2"))).otherwise(none()))
    spots = F.when(article, passages(c("_text"), name_keys(c("brand")), 120, 700)).when(~is_list, passages(c("_text"), anchors, 700, 700))
    df = df.withColumn("_spots", spots).withColumn("_full", F.filter("_spots", lambda x: lacks(x, c("_f")) == 0))
    named_days = F.size(F.filter(F.array(*[F.lit(d) for d in S.WEEKDAYS]), lambda d: F.rlike(c("_text"), F.concat(F.lit("\\b"), d, F.lit("s?\\b")))))
    whole = ~article & (named_days <= 2) & (lacks(c("_text"), c("_f")) == 0) & has_day(c("_text"))
    good = F.exists("_full", has_day) | whole
    claims_nothing = (F.size("_f.amounts") + F.size("_f.percents") == 0) & ~c("_f.half") & ~c("_f.bogo")
    on = lambda cond, bad: F.coalesce(cond & bad, F.lit(False))
    wrong_day = ~F.exists(names, lambda d: F.contains(head, d))
    issues = [("the list page is not for a day this runs on", on(is_list, wrong_day)), ("the list page no longer has an entry for this chain", on(is_list & ~wrong_day, F.size("_entries") == 0)),
              ("the chain's entry lacks a claim", on(is_list & ~wrong_day, (F.size("_entries") > 0) & (F.size("_good") == 0))),
              ("the page says it ended", on(is_list & ~wrong_day, (F.size("_good") > 0) & F.forall("_good", lambda x: over(x, c("_f"), today)))),
              ("the article does not name this place", on(article, F.size("_spots") == 0)), ("the page has none of the claims", on(~is_list & ~article, F.size("_spots") == 0)),
              ("the claims are on the page but no day this runs on is near them", on(~is_list & ~good, F.size("_full") > 0)),
              ("no passage has all of the claims", on(~is_list & ~good, (F.size("_spots") > 0) & (F.size("_full") == 0)))]
    return verdict(df, issues, [("no page", c("_text").isNull()), ("the offer claims nothing that a page could state", claims_nothing)]).drop("_html", "_text", "_f", "_entries", "_good", "_spots", "_full")
