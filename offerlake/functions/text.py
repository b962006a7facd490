"""Names, words and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import bind

# Letters written with accents and the plain letters they compare as.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY"

# Words of a title that name no goods.
NOT_GOODS = """
the and for with from your our this that all any new more only just each per set sets pack packs count size sizes piece
pieces pcs inch inches lbs gal qty assorted select selected variety varieties style styles color colors colour item items
deal deals sale sales off save saves savings saving free shipping shipped price prices priced reg regular regularly now
was get buy buys when plus extra coupon coupons code codes promo today limited time exclusive bonus value great big best
top low lowest sold store stores online shop clearance discount discounts order orders spend members member rewards
reward via has have its
""".split()

# Words of an offer that say nothing about what is offered, and words about when, where and how.
OFFER_STOP = """
a an and any are at be by can each enjoy every for free from get gets has have in is it its just more new of off offer
offers on one only or order orders our per plus price score so that the their this to two up valid when with you your
deal deals special specials day week weekly all day long also available good online app store dine members rewards member
reward purchase regular reg about save
through thru until till after before during now local time times today tonight grab score redeem redeemed registered user
users valid posted page website site detail details visit story stories starting start check include includes included
including choice enjoy celebrate guest guests customer customers location locations participating select selected announced
chain restaurant restaurants jan feb mar apr may jun jul aug sep sept oct nov dec january february march april june july
august september october november december
""".split()

DAY_WORD = r"(?i)\b(?:mon|tues|wednes|thurs|fri|satur|sun)days?\b"
GOODS_WORD = r"([a-z][a-z0-9]*(?:['&+-][a-z0-9]+)*)"


def fn_norm(col: Column) -> Column:
    """Comparison key of a name: lower case, "&" as "and", letters and digits only."""
    return F.regexp_replace(F.replace(F.lower(F.coalesce(col, F.lit(""))), F.lit("&"), F.lit("and")), "[^a-z0-9]", "")


def fn_fold(col: Column) -> Column:
    """`fn_norm` after accents are taken off."""
    return fn_norm(F.translate(F.coalesce(col, F.lit("")), ACCENTED, PLAIN))


def fn_clean(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), r"[\s ]+", " "))


def straight(col: Column) -> Column:
    """Curly quotes as straight ones."""
    return F.translate(F.coalesce(col, F.lit("")), "’‘“”", "''\"\"")


def fn_tidy(col: Column) -> Column:
    """One spelling for quotes and dashes, no trademark signs, single spaces, none before punctuation."""
    t = F.translate(straight(col), "–—−®™", "---")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"\s+([.,;:!?])", "$1"))


def fn_words(*cols: Column) -> Column:
    """Distinct words of a title that could name goods or a brand."""
    text = F.translate(F.lower(F.concat_ws(" ", *cols)), "’", "'")
    words = F.transform(F.regexp_extract_all(text, F.lit(GOODS_WORD), F.lit(1)),
                        lambda w: F.regexp_replace(w, r"'s?$", ""))
    stop = F.array(*[F.lit(w) for w in NOT_GOODS])
    keep = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike(r"^[a-z]{1,2}\d.*$"))
    return F.array_except(F.array_distinct(keep), stop)


def plain_words(col: Column, pattern: str = r"[a-z0-9]+") -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(f"({pattern})"), F.lit(1)))


def fn_offer_words(text: Column, brand: Column) -> Column:
    """Distinct content words and figures of an offer, without its brand, its days and the stop words."""
    body = F.replace(F.regexp_replace(F.lower(fn_tidy(text)), DAY_WORD, " "), F.lit("1/2"), F.lit("half"))
    words = F.transform(F.regexp_extract_all(body, F.lit(r"([a-z]{3,}|\$?\d+(?:\.\d\d)?)"), F.lit(1)),
                        lambda w: F.when(w.endswith("s") & (F.length(w) > 4), w.substr(F.lit(1), F.length(w) - 1))
                        .otherwise(w))
    stop = F.array(*[F.lit(w) for w in OFFER_STOP])
    left = F.array_except(F.array_except(F.array_distinct(words), stop), plain_words(brand, "[a-z]+"))
    return F.array_distinct(F.transform(left, lambda w: F.when(w == "buy", F.lit("bogo")).otherwise(w)))


def fn_overlap(a: Column, b: Column, kind: str = "jaccard") -> Column:
    """Shared words of two arrays as a share of their union ("jaccard"), of the smaller ("overlap") or of `a`
    ("containment"); 0 when there is nothing to divide by."""
    shared = F.size(F.array_intersect(a, b))
    whole = {"jaccard": F.size(F.array_union(a, b)), "overlap": F.least(F.size(a), F.size(b)),
             "containment": F.size(a)}[kind]
    return F.when(whole > 0, shared / whole).otherwise(F.lit(0.0))


def fn_host(url: Column) -> Column:
    """The host a link names, lower case, without "www." and port; "" when there is none."""
    first = F.trim(F.split_part(F.coalesce(url, F.lit("")), F.lit(";"), F.lit(1)))
    host = F.lower(F.regexp_extract(first, r"^(?:(?i:https?)://)?(?:[^/@?#]*@)?([^/:?#\s]+)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host.contains("."), host).otherwise(F.lit(""))


def fn_hosts(url: Column) -> Column:
    """Every host a link leads to, through redirects that carry the destination in their query."""
    once = F.coalesce(F.try_url_decode(url), url)
    twice = F.coalesce(F.try_url_decode(once), once)
    inner = F.regexp_extract_all(twice, F.lit(r"(?i)https?://([^/:?#&\s]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.concat(F.array(fn_host(url)),
                                              F.transform(inner, lambda h: F.regexp_replace(F.lower(h), r"^www\.", ""))),
                                     lambda h: h != ""))


def fn_site_key(host: Column) -> Column:
    """A stable negative number for a site."""
    return -F.conv(F.substring(F.sha1(host), 1, 12), 16, 10).cast("bigint")


def fn_product_ids(texts: Column) -> Column:
    """Product ids in an array of links, as written in product paths, in order."""
    ids = F.transform(texts, lambda t: F.regexp_extract_all(
        F.coalesce(t, F.lit("")), F.lit(r"(?i)/(?:dp|gp/product|gp/aw/d)/([a-z0-9]{10})"), F.lit(1)))
    return F.array_distinct(F.transform(F.flatten(ids), F.upper))


def positions(text: Column, phrase: Column) -> Column:
    """0-based starts of a phrase's occurrences, letter case aside."""
    pieces = F.split(F.lower(text), F.concat(F.lit("\\Q"), F.lower(phrase), F.lit("\\E")))
    walked = F.aggregate(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, piece: F.struct((acc["at"] + F.length(piece) + F.length(phrase)).alias("at"),
                                    F.array_append(acc["starts"], acc["at"] + F.length(piece)).alias("starts")))
    return walked["starts"]


def fn_phrase_near(text: Column, phrases: Column, within: int = 500) -> Column:
    """Whether all phrases stand within `within` characters of each other: null-safe struct(found, lo, hi) of the
    tightest passage around an occurrence of the first phrase. `within` 0 sets no bound."""
    want = F.filter(F.transform(phrases, fn_tidy), lambda p: p != "")
    body = F.coalesce(text, F.lit(""))
    spots = F.transform(want, lambda p: F.struct(positions(body, p).alias("starts"), F.length(p).alias("len")))

    def nearest(spots: Column) -> Column:
        def passage(start: Column) -> Column:
            def widen(acc: Column, spot: Column) -> Column:
                def reach(near: Column) -> Column:
                    return F.struct(F.least(acc["lo"], near).alias("lo"), F.greatest(acc["hi"], near + spot["len"]).alias("hi"))
                return bind(F.array_min(F.transform(spot["starts"], lambda x: F.struct(F.abs(x - start).alias("d"), x.alias("x"))))["x"], reach)
            first = F.struct(start.alias("lo"), (start + spots[0]["len"]).alias("hi"))
            rest = F.slice(spots, 2, F.greatest(F.size(spots) - 1, F.lit(0)))
            return bind(F.aggregate(rest, first, widen),
                        lambda span: F.struct((span["hi"] - span["lo"]).alias("width"), span["lo"].alias("lo"), span["hi"].alias("hi")))

        complete = (F.size(spots) > 0) & ~F.exists(spots, lambda s: F.size(s["starts"]) == 0)
        best = F.when(complete, F.array_min(F.transform(spots[0]["starts"], passage)))

        def judge(best: Column) -> Column:
            found = F.coalesce(best.isNotNull() & ((best["width"] <= within) if within else F.lit(True)), F.lit(False))
            return F.struct(found.alias("found"), F.when(found, best["lo"]).alias("lo"), F.when(found, best["hi"]).alias("hi"))
        return bind(best, judge)
    return bind(spots, nearest)
