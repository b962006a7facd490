"""Sale posts read as sales: what they offer, when, where, under which code and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fn_hosts, fn_nearest_year, fn_norm
from ..functions.amounts import bind, dollars_short, general, number, rounded
from ..functions.text import fn_clean, straight
from ..functions.times import month_number, wall, weekday_number
from ..rules import wordings as R
from .wordwork import (bogo_of, ci, each_said, first_label, got, got_number, matches, may_match, read_match, says, staged, without, without_first)

CENTRAL = "America/Chicago"


def split_title(title: Column) -> Column:
    """struct(head, offer): what is on sale and the offer, for a title that puts the offer after its last colon; else "" and the title."""
    def read(t: Column) -> Column:
        parts = F.struct(F.regexp_extract(t, r"^(.*): (.*)$", 1).alias("head"), F.regexp_extract(t, r"^(.*): (.*)$", 2).alias("offer"))
        split = bind(parts, lambda x: F.when((F.length(x["head"]) >= 3) & says(F.trim(x["offer"]), R.OFFER_START), x))
        return F.coalesce(F.when(t.contains(": "), split), F.struct(F.lit("").alias("head"), t.alias("offer")))
    return bind(straight(title), read)


def offer_part(title: Column) -> Column:
    """The words that state the offer, without shipping or an aside."""
    return F.trim(without(without(split_title(title)["offer"], R.SHIP_TAIL, ""), R.ASIDE, ""))


OFFER_COLUMNS = ["pct", "upto", "extra", "extra_upto", "off", "off_upto", "min_spend", "reward", "bogo", "bogo_pct", "buy_n",
                 "offer", "badge", "badge_soft"]


def _max_number(text: Column, pattern: str) -> Column:
    return F.array_max(F.transform(matches(text, pattern), lambda m: number(F.regexp_extract(m, ci(pattern), 1))))


def job_sale_offer(posts: DataFrame) -> DataFrame:
    """The offer a title states, and its words and badge. Needs title. Each stage takes what it read out of the text, so
    the next cannot read it as something else."""
    c = F.col
    within = lambda v: F.when((v > 0) & (v < 100), v)                                          # noqa: E731
    bare = says(c("_t1"), R.BOGO_BARE) & ~says(c("_t1"), r"\bbuy\s+\w+,?\s+get\b")

    is_next = says(c("_t1"), R.BOGO_NEXT)
    next_buy = F.coalesce(got_number(c("_t1"), R.BOGO_NEXT, 1), F.lit(1.0)).cast("int")
    next_off = got_number(c("_t1"), R.BOGO_NEXT, 2)
    lo_raw, hi_raw = got_number(c("_t2"), R.RANGE_PCT, 1), got_number(c("_t2"), R.RANGE_PCT, 2)
    lo, hi = F.least(lo_raw, hi_raw), F.greatest(lo_raw, hi_raw)
    plus = c("_t2").contains("+") & F.regexp_extract(c("_t2"), f"(?is)^(.*?)(?:{R.RANGE_PCT})", 1).contains("+")
    extra_said = _max_number(c("_t3"), R.EXTRA_PCT)
    spend_kind = F.lower(F.coalesce(got(c("_t3"), R.SPEND, 3), F.lit("")))

    def biggest(pattern: str, amount: tuple[int, ...], ceiling: tuple[int, ...], order_size: int | None) -> Column:
        """The largest amount off; of equals the first."""
        one = lambda m, groups: F.coalesce(*[F.nullif(F.regexp_extract(m, ci(pattern), g), F.lit("")) for g in groups])
        found = F.transform(matches(c("_t3"), pattern), lambda m, i: F.struct(
            number(one(m, amount)).alias("v"), (-i).alias("i"), one(m, ceiling).isNotNull().alias("upto"),
            (number(one(m, (order_size,))) if order_size else F.lit(None).cast("double")).alias("of")))
        return F.array_max(found)

    off, said = biggest(R.OFF, (2,), (1,), 3), biggest(R.OFF_SAID, (2, 4), (1, 3), None)
    pct_of = got_number(c("_t5"), R.PCT_OF, 1)
    df = staged(
        posts, OFFER_COLUMNS[:11],
        {"_t0": F.regexp_replace(offer_part(c("title")), r"\(([^()]*%[^()]*)\)", " $1 ")},
        {"_buy_pct": got_number(c("_t0"), R.BUY_N_PCT, 2), "_n1": got_number(c("_t0"), R.BUY_N_PCT, 1).cast("int"),
         "_t0b": F.when(says(c("_t0"), R.BUY_N_PCT), without_first(c("_t0"), R.BUY_N_PCT)).otherwise(c("_t0"))},
        {"_buy_off": F.when(c("_n1").isNull(), got_number(c("_t0b"), R.BUY_N_SAVE, 2)),
         "_n2": F.when(c("_n1").isNull(), got_number(c("_t0b"), R.BUY_N_SAVE, 1).cast("int"))},
        {"_t1": F.when(c("_n2").isNotNull(), without_first(c("_t0b"), R.BUY_N_SAVE)).otherwise(c("_t0b")),
         "buy_n": F.coalesce("_n1", "_n2")},
        {"_next": is_next, "_bare": ~is_next & c("buy_n").isNull() & bare, "_bogo": bogo_of(c("_t1"))},
        {"bogo": F.when(c("_next"), F.concat(F.lit("buy "), next_buy.cast("string"), F.lit(" get 1 "), general(next_off), F.lit("% off")))
         .when(c("_bare"), "buy one, get one deals").when(c("buy_n").isNull(), c("_bogo.label")),
         "bogo_pct": F.when(c("_next"), rounded(next_off / (next_buy + 1), 1)).when(~c("_bare") & c("buy_n").isNull(), c("_bogo.pct"))},
        {"_t2": F.when(c("_next"), without_first(c("_t1"), R.BOGO_NEXT)).when(c("_bare"), without(c("_t1"), R.BOGO_BARE))
         .when(c("buy_n").isNull() & c("bogo").isNotNull(), without(c("_t1"), R.BOGO_ANY)).otherwise(c("_t1"))},
        {"_range": says(c("_t2"), R.RANGE_PCT), "_plus": plus},
        {"_t3": F.when(c("_range"), without_first(c("_t2"), R.RANGE_PCT)).otherwise(c("_t2")),
         "_lo": F.when(c("_range"), lo), "_hi": F.when(c("_range"), hi)},
        {"_said_extra": extra_said},
        {"extra": F.greatest(F.when(c("_plus"), c("_lo")), c("_said_extra")),
         "extra_upto": F.when(c("_plus") & c("_said_extra").isNull(), c("_hi")),
         "_t4": without(c("_t3"), R.EXTRA_PCT)},
        {"upto": F.greatest(F.when(~c("_plus"), c("_hi")), _max_number(c("_t4"), R.UPTO_PCT)), "_t5": without(c("_t4"), R.UPTO_PCT)},
        {"_firm": _max_number(c("_t5"), R.FIRM_PCT), "_pct0": F.coalesce(c("_buy_pct"), F.when(~c("_plus"), c("_lo")))},
        {"pct": F.coalesce("_pct0", "_firm"), "_size": F.when(c("_pct0").isNull() & (pct_of == c("_firm")), got_number(c("_t5"), R.PCT_OF, 2)),
         "_spend": says(c("_t3"), R.SPEND), "_off": off, "_said": said},
        {"_best": F.when(c("_buy_off").isNull() | (c("_off.v") > c("_buy_off")), c("_off"))},
        {"off": F.when(c("_spend"), got_number(c("_t3"), R.SPEND, 2)).otherwise(F.coalesce("_best.v", "_buy_off", "_said.v")),
         "off_upto": F.when(c("_spend"), False).otherwise(F.coalesce(F.when(c("_best").isNotNull(), c("_best.upto")),
                                                                     F.when(c("_buy_off").isNull(), c("_said.upto")), F.lit(False))),
         "min_spend": F.when(c("_spend"), got_number(c("_t3"), R.SPEND, 1)).when(c("_best").isNotNull(), c("_best.of")).otherwise(c("_size")),
         "reward": F.when(~c("_spend") | (spend_kind == "") | spend_kind.contains("off"), "").when(spend_kind.contains("credit"), "credit")
         .when(spend_kind.contains("cash") | spend_kind.contains("reward"), "store cash").otherwise("gift card")},
        {"pct": within(c("pct")), "upto": within(c("upto")), "extra": within(c("extra")), "extra_upto": within(c("extra_upto"))},
        {"upto": F.when(c("pct").isNull() | (c("upto") > c("pct")), c("upto"))})
    return _offer_words(df)


def _offer_words(df: DataFrame) -> DataFrame:
    c = F.col
    p = lambda v: F.concat(general(v), F.lit("%"))                                              # noqa: E731
    has = lambda x: c(x).isNotNull()                                                            # noqa: E731
    set_ = F.regexp_extract
    form = r"^buy (\d+) get (\d+) (free|(\d+)% off)"
    b, g, kind, off = (set_("bogo", form, i) for i in (1, 2, 3, 4))
    bogo_badge = F.when(has("bogo"), F.concat(
        F.when((kind == "") | ((b == "1") & (g == "1")), F.lit("BOGO")).otherwise(F.concat(F.lit("B"), b, F.lit("G"), g)),
        F.when((kind == "") | (kind == "free"), F.lit("")).otherwise(F.concat(F.lit(" "), off, F.lit("%")))))
    extra_amount = F.when(c("extra_upto") > 0, F.concat(general(c("extra")), F.lit("–"), p(c("extra_upto")))).otherwise(p(c("extra")))
    order = lambda cond: F.when(cond & (c("min_spend") > 0), F.concat(F.lit(" "), dollars_short(c("min_spend")), F.lit("+"))).otherwise("")
    when_buy = lambda cond: F.when(cond & (c("buy_n") > 0), F.concat(F.lit(" when you buy "), c("buy_n").cast("string"))).otherwise("")
    span = F.concat(general(c("pct")), F.lit("–"), p(c("upto")), F.lit(" off"))
    percent = (F.when(has("pct") & has("upto"), span)
               .when(has("pct"), F.concat(p(c("pct")), F.lit(" off"), when_buy(F.lit(True)), order(c("off").isNull())))
               .when(has("upto"), F.concat(F.lit("up to "), p(c("upto")), F.lit(" off"))))
    extra = F.when(has("extra"), F.concat(F.lit("extra "), extra_amount, F.lit(" off")))
    reward = c("reward") != ""
    off = F.when(has("off"), F.when(reward & (c("min_spend") > 0), F.concat(F.lit("Spend "), dollars_short(c("min_spend")), F.lit(", get "),
                                                                          dollars_short(c("off")), F.lit(" in "), c("reward")))
                 .when(reward, F.concat(dollars_short(c("off")), F.lit(" in "), c("reward")))
                 .otherwise(F.concat(F.when(c("off_upto"), "up to ").otherwise(""), dollars_short(c("off")), F.lit(" off"),
                                     order(F.lit(True)), when_buy(c("pct").isNull()))))
    bogo = F.concat(F.upper(F.substring("bogo", 1, 1)), F.expr("substring(bogo, 2)"))
    text = F.concat_ws(" + ", bogo, percent, extra, off)
    hard = F.coalesce(bogo_badge, F.when(has("pct") & has("upto"), span).when(has("pct"), F.concat(p(c("pct")), F.lit(" off"))))
    ceiling = F.when(hard.isNull() & has("upto") & c("extra").isNull(), F.concat(F.lit("Up to "), p(c("upto"))))
    extra_badge = F.when(has("extra"), F.concat(F.lit("Extra "), extra_amount))
    off_badge = F.when(has("off"), F.when(c("off_upto"), F.concat(F.lit("Up to "), dollars_short(c("off"))))
                       .otherwise(F.concat(dollars_short(c("off")), F.lit(" off"))))
    firm = F.coalesce(hard, ceiling, extra_badge)
    return df.withColumns({"offer": F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text))),
                           "badge": F.coalesce(firm, off_badge, F.lit("")),
                           "badge_soft": ceiling.isNotNull() | (firm.isNull() & off_badge.isNotNull())})


# --- when ---

def _md(month: Column, day: Column, ref: Column) -> Column:
    return fn_nearest_year(month, day, ref)


def _int(x: Column) -> Column:
    return x.try_cast("int")


def _span(first: Column, last: Column, said: Column) -> Column:
    return bind(F.struct(first.alias("first"), last.alias("last"), F.trim(said).alias("said")),
                lambda x: F.when(x["first"].isNotNull() & x["last"].isNotNull(), x))


def stated_range(text: Column, ref: Column) -> Column:
    """A span of dates a text states: struct(first, last, said), or null."""
    def by_name(g) -> Column:
        return F.struct(_span(_md(month_number(g(1)), _int(g(2)), ref), _md(month_number(F.coalesce(g(3), g(1))), _int(g(4)), ref), g(0)).alias("r"))

    def by_number(g) -> Column:
        return F.struct(_span(_md(_int(g(1)), _int(g(2)), ref), _md(_int(g(3)), _int(g(4)), ref), g(0)).alias("r"))
    # a range in words decides, also when its dates do not exist
    return F.coalesce(read_match(text, R.RANGE_MD, by_name), read_match(text, R.RANGE_NUM, by_number))["r"]


def stated_end(text: Column, ref: Column) -> Column:
    """An end a text states in words: struct(last, said), or null."""
    end = lambda day, g: F.struct(day.alias("last"), F.trim(g(0)).alias("said"))                    # noqa: E731

    def by_number(g) -> Column:
        return F.when(_int(g(1)).between(1, 12) & _int(g(2)).between(1, 31), end(_md(_int(g(1)), _int(g(2)), ref), g))

    def by_weekday(g) -> Column:
        return end(F.date_add(ref, F.pmod(weekday_number(g(1)) - F.weekday(ref), F.lit(7)).cast("int")), g)
    return F.coalesce(read_match(text, R.END_MD, lambda g: end(_md(month_number(g(1)), _int(g(2)), ref), g)),
                      read_match(text, R.END_NUM, by_number), read_match(text, R.END_DAY, by_weekday))


def job_sale_dates(posts: DataFrame, now: Column, zone: str = CENTRAL) -> DataFrame:
    """When a sale starts and ends, and how that is known. Needs title, text, posted_at, expires_at, expires_stated. The
    source's own end comes first, then the title's words, then the text's."""
    c = F.col
    z = F.lit(zone)
    believable = lambda r: bind(r, lambda x: F.when((x["first"] <= x["last"]) & (F.datediff(x["last"], x["first"]) <= 62), x))
    stated = c("expires_stated") & c("expires_at").isNotNull()
    start_md = read_match(c("_text"), R.START_MD, lambda g: _md(month_number(g(1)), _int(g(2)), c("_posted")))
    only = read_match(c("_text"), R.ONLY_MD, lambda g: F.struct(_md(month_number(g(1)), _int(g(2)), c("_posted")).alias("day"), F.trim(g(0)).alias("said")))
    stated_day = F.to_date(F.from_utc_timestamp("expires_at", z))
    said = lambda x: F.concat(F.lit("the post says “"), x, F.lit("”"))                           # noqa: E731
    return staged(
        posts, ["starts_at", "ends_at", "ends_how"],
        {"_posted": F.to_date(F.from_utc_timestamp(F.coalesce("posted_at", now), z)), "_title": straight(c("title")),
         "_body": straight(c("text"))},
        {"_text": F.concat("_title", F.lit(". "), "_body"), "_r1": believable(stated_range(c("_title"), c("_posted")))},
        {"_e": F.when(c("_r1").isNull(), F.coalesce(stated_end(c("_title"), c("_posted")), stated_end(c("_body"), c("_posted")))),
         "_r2": believable(stated_range(c("_body"), c("_posted")))},
        {"_r": F.coalesce("_r1", F.when(c("_e").isNull(), c("_r2")))},
        {"_end0": F.coalesce("_r.last", "_e.last"), "_start0": F.coalesce(c("_r.first"), start_md), "_only": only, "_today": says(c("_text"), R.TODAY_ONLY),
         "_how0": said(F.coalesce("_r.said", "_e.said"))},
        {"_end": F.coalesce("_end0", "_only.day", F.when(c("_today"), c("_posted"))),
         "_how": F.when(c("_end0").isNotNull(), c("_how0")).when(c("_only.day").isNotNull(), said(c("_only.said")))
         .when(c("_today"), "the post says “today only”").otherwise("")},
        {"_late": c("_end") < F.date_sub(c("_posted"), 1)},
        {"starts_at": F.when(F.when(stated, says(c("_text"), R.START_MD) & (c("_posted") < c("_start0")) & (c("_start0") <= stated_day))
                             .otherwise((c("_start0") > c("_posted")) & (c("_end").isNull() | (c("_start0") <= c("_end")))),
                             wall(c("_start0"), 0, z)),
         "ends_at": F.when(stated, c("expires_at")).when(~F.coalesce(c("_late"), F.lit(False)), wall(c("_end"), 86399, z)),
         "ends_how": F.when(stated, F.concat("source", F.lit(" gives this end date")))
         .when(F.coalesce(c("_late"), F.lit(False)), "").otherwise(c("_how"))})


def job_promo_dates(posts: DataFrame, start: Column, end: Column, zone: str = CENTRAL) -> DataFrame:
    """A promotion's first and last day and how they were read, with the next of its weekdays in the window. Needs title,
    text, posted_at, expires_at, expires_stated. Adds first_day, last_day, dates_how, recurring and reason."""
    c, z = F.col, F.lit(zone)
    day0, day1 = F.to_date(F.from_utc_timestamp(start, z)), F.to_date(F.from_utc_timestamp(end, z))
    until = read_match(c("_text"), R.PROMO_UNTIL, lambda g: _md(F.coalesce(month_number(g(1)), _int(g(3))), F.coalesce(_int(g(2)), _int(g(4))), c("_posted")))
    part = lambda m, rx, g: F.regexp_extract(m, ci(rx), g)                                       # noqa: E731
    on_md = F.transform(matches(c("_text"), R.ON_MD), lambda m: _md(month_number(part(m, R.ON_MD, 1)), _int(part(m, R.ON_MD, 2)), c("_posted")))
    on_num = F.transform(matches(c("_text"), R.ON_NUM), lambda m: _md(_int(part(m, R.ON_NUM, 1)), _int(part(m, R.ON_NUM, 2)), c("_posted")))
    recurring = F.array_sort(F.array_distinct(F.transform(matches(c("_text"), R.RECURRING),
                                                          lambda m: weekday_number(part(m, R.RECURRING, 1)))))
    nxt = F.array_min(F.transform(c("recurring"), lambda d: F.date_add(day0, F.pmod(d - F.weekday(day0), F.lit(7)).cast("int"))))
    stated = F.when(c("expires_stated"), F.to_date(F.from_utc_timestamp("expires_at", z)))
    return staged(
        posts, ["first_day", "last_day", "dates_how", "recurring", "reason"],
        {"_posted": F.to_date(F.from_utc_timestamp(F.coalesce("posted_at", start), z)),
         "_text": F.concat("title", F.lit(". "), F.coalesce("text", F.lit("")))},
        {"_r": stated_range(c("_text"), c("_posted")), "_is_range": says(c("_text"), R.RANGE_MD) | says(c("_text"), R.RANGE_NUM),
         "_is_until": says(c("_text"), R.PROMO_UNTIL), "_until": until,
         "_on": F.array_sort(F.array_compact(F.concat(on_md, on_num))), "_today": says(c("_text"), R.TODAY), "recurring": recurring},
        {"_f": F.when(c("_is_range"), c("_r.first")).when(c("_is_until"), F.lit(None)).when(F.size("_on") > 0, F.get("_on", 0))
         .when(c("_today"), c("_posted")),
         "_l": F.when(c("_is_range"), c("_r.last")).when(c("_is_until"), c("_until")).when(F.size("_on") > 0, F.element_at("_on", -1))
         .when(c("_today"), c("_posted")),
         "_h": F.when(c("_is_range"), "date range").when(c("_is_until"), "end date")
         .when(F.size("_on") > 0, F.when(F.size(F.array_distinct("_on")) == 1, "single date").otherwise("dates"))
         .when(c("_today"), "today (post date)").otherwise("")},
        {"_take": stated.isNotNull() & (c("_f").isNull() | (stated >= c("_f")))},
        {"_l": F.when(c("_take"), stated).otherwise(c("_l")),
         "_h": F.when(c("_take") & (c("_h") == ""), "stated expiry").otherwise(c("_h"))},
        {"_rec": (F.size("recurring") > 0) & c("_f").isNull()},
        {"_f": F.when(c("_rec"), nxt).otherwise(c("_f")), "_l": F.when(c("_rec"), F.coalesce("_l", day1)).otherwise(c("_l")),
         "_h": F.when(c("_rec"), "recurring weekday").otherwise(c("_h"))},
        {"_none": c("_f").isNull() & c("_l").isNull()},
        {"first_day": F.when(c("_none"), c("_posted")).otherwise(c("_f")),
         "last_day": F.when(c("_l") < c("_f"), c("_f")).otherwise(c("_l")),
         "dates_how": F.when(c("_none"), "no dates stated").otherwise(c("_h"))},
        {"_vf": wall(F.coalesce("first_day", "_posted"), 0, z), "_vt": F.coalesce(wall(c("last_day"), 86399, z), end)},
        {"reason": F.when(c("_none") & (F.datediff(day0, c("_posted")) > 3), "promotion: no dates and posted over 3 days ago")
         .when((c("_vt") < start) | (c("_vf") > end), "promotion: outside the 7-day window")})


# --- code, shipping, conditions ---

def shipping_words(title: Column) -> Column:
    def named(w: Column) -> Column:
        low = F.lower(w)
        return (F.when(low == "prime", "Free shipping with Prime").when(low == "exclusions", "Free shipping, with exclusions")
                .when(low == "select purchase", "Free shipping on some orders").otherwise(F.concat(F.lit("Free shipping with "), w)))

    def read(t: Column) -> Column:
        least = F.concat(F.lit("Free shipping on "), bind(got_number(t, R.FREE_SHIP_MIN), dollars_short), F.lit("+"))
        stated = bind(F.regexp_extract(t, r"\+\s*\$(\d+(?:\.\d\d)?)\s+shipping", 1), lambda x: F.when(x != "", F.concat(dollars_short(x.try_cast("double")), F.lit(" shipping"))))
        return F.coalesce(least, bind(got(t, R.FREE_SHIP_WITH), named), F.when(says(t, R.FREE_SHIP), "Free shipping"), F.when(says(t, "shipping varies"), "Shipping varies"),
                          F.when(t.contains("$"), stated), F.lit(""))
    return bind(straight(title), read)


def job_sale_code_shipping_conditions(posts: DataFrame, today: Column, zone: str = CENTRAL) -> DataFrame:
    """The code a post states as written, what it is for, shipping and conditions. Needs title, text, posted_at and the
    offer columns. A code's own sentence decides: one for cardholders or whose day has passed is not this sale's; with an
    `other_stores` column (array of other stores' names), nor is one whose sentence names another store."""
    c = F.col
    full = straight(F.concat("title", F.lit(". "), F.coalesce("text", F.lit(""))))
    posted = F.to_date(F.from_utc_timestamp("posted_at", F.lit(zone)))
    # a cheap look ahead first, so the look behind is tried at few places
    code_at = r"\b(?=(?i:promo|coupon|discount|offer|checkout|savings|\s?code))(?<!\b(?i:no)\s{0,3})(?<!\b(?i:without)\s{0,3})" + R.CODE
    others = c("other_stores") if "other_stores" in posts.columns else F.array().cast("array<string>")

    def in_sentence(s: Column) -> Column:
        def one(m: Column) -> Column:
            g = lambda i: F.nullif(F.regexp_extract(m, R.CODE, i), F.lit(""))                    # noqa: E731
            return bind(F.struct(F.coalesce(g(1), g(2), g(3)).alias("quoted"), g(4).alias("bare")), judge)

        def judge(x: Column) -> Column:
            code = F.coalesce(x["quoted"], x["bare"])
            good = F.when(x["bare"].isNotNull(), ~F.upper(x["bare"]).isin(*R.NOT_A_CODE)).otherwise(x["quoted"].rlike("[A-Z0-9]"))
            over = F.coalesce(F.coalesce(stated_range(s, posted)["last"], stated_end(s, posted)["last"]) < today, F.lit(False))
            fits = good & ~says(s, R.CARD) & ~F.exists(others, lambda o: s.contains(o)) & ~over
            ship = says(s, R.CODE_SHIP) & ~says(F.replace(s, code, F.lit(" ")), R.CODE_DISCOUNT)
            note = F.when(ship, F.when(says(s, r"\bdelivery\b"), "for free delivery").otherwise("for free shipping")).otherwise("")
            return F.when(fits, F.struct(code.alias("code"), note.alias("note"), says(s, R.CODE_NEW).alias("new")))
        said = F.when(may_match(s, R.CODE), F.regexp_extract_all(s, F.lit(code_at), F.lit(0))).otherwise(F.array().cast("array<string>"))
        return F.transform(said, one)

    # a list of sentences, each end kept with its sentence
    found = F.array_compact(F.flatten(F.transform(F.split(full, r"(?<=[.!?]) "), in_sentence)))
    t = c("_said")
    body_today = says(straight(c("text")), r"\btoday[- ]only\b")
    of_title = each_said(t, [rx for rx, _ in R.SALE_CONDITIONS], lambda said: F.array(
        *[F.when(s | (body_today if label == "today only" else F.lit(False)), F.lit(label)) for s, (_, label) in zip(said, R.SALE_CONDITIONS)]))
    reward = F.coalesce(c("reward"), F.lit("")) != ""
    listed = F.array_compact(F.concat(F.array(first_label(t, R.SALE_MEMBERS)), of_title, F.array(
        F.when((c("min_spend") > 0) & ~reward, F.concat(F.lit("on orders of "), dollars_short(c("min_spend")), F.lit("+"))),
        F.when((c("buy_n") > 0) & c("pct").isNotNull(), F.concat(F.lit("when you buy "), c("buy_n").cast("string"))),
        F.when(reward, F.concat(F.lit("paid as a "), c("reward"))),
        F.when(c("_code.new"), F.lit("the code is for new customers")))))
    return staged(posts, ["code", "code_note", "shipping", "conditions"],
                  {"_code": F.get(found, 0), "_said": bind(split_title(c("title")), lambda x: F.concat(x["head"], F.lit(" "), without(x["offer"], R.SHIP_TAIL, "")))},
                  {"code": F.coalesce("_code.code", F.lit("")), "code_note": F.coalesce("_code.note", F.lit("")),
                   "shipping": shipping_words(c("title")), "conditions": F.array_distinct(listed)})


# --- name ---

def is_store_event(name: Column) -> Column:
    """A name made of nothing but the words of sale events."""
    rest = without(F.regexp_replace(straight(name), r"[^\w\s'-]", " "), R.EVENT_WORDS)
    return F.size(F.filter(F.split(F.trim(rest), r"\s+"), lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d+$"))) == 0


def job_sale_name(posts: DataFrame) -> DataFrame:
    """The sale in a few words, without its store, offer or shipping, and whether it is an event of the whole store. Needs
    title, store_names (array of the store's spellings)."""
    c = F.col
    by_length = F.array_sort(c("store_names"), lambda a, b: F.length(b) - F.length(a))
    names = F.array_join(F.transform(by_length, lambda n: F.concat(F.lit("\\Q"), straight(n), F.lit("\\E"))), "|")
    # no names: a pattern that matches nothing
    names = F.when(F.size("store_names") > 0, names).otherwise(F.lit("(?!)"))
    around = lambda lead, tail: F.concat(F.lit("(?i)" + lead), c("_names"), F.lit(tail))           # noqa: E731
    t0 = bind(split_title(c("title")), lambda x: F.when(x["head"] != "", x["head"]).otherwise(x["offer"]))
    edges = lambda t: F.regexp_replace(F.regexp_replace(t, r"^[\s|=+:–—!*-]+", ""), r"[\s|=+:–—-]+$", "")
    return staged(
        posts, ["name", "sitewide", "store_event"],
        {"_a": without(without(t0, R.ASIDE, ""), R.ASIDE, ""), "_names": names},
        {"_a": without(without(without(without(c("_a"), R.DECOR, ""), R.FOR_MEMBERS, ""), R.SHIP_TAIL, ""), R.OFFER_WORDS)},
        {"_a": F.regexp_replace(c("_a"), around(r"\s+(?:at|on|from|via|@)\s+(?:the\s+)?(?:", r")(?:\.com)?(?:'s)?\b"), F.lit(" "))},
        {"_a": F.regexp_replace(c("_a"), around(r"(?<![\w&'.-])(?:", r")(?:\.com)?(?:'s)?(?![\w&-])"), F.lit(" "))},
        {"_a": without(edges(without(c("_a"), R.DECOR, "")), r"\s+(?:for|w/|with|on|at|in|from)\s*$", "")},
        {"_a": F.regexp_replace(F.regexp_replace("_a", r"\s{2,}", " "), r"^[ ,.;!*]+|[ ,.;!*]+$", "")},
        {"name": F.when(F.length("_a") >= 3, c("_a")).when(says(c("title"), R.SITEWIDE), "Sitewide sale").otherwise("Sale")},
        {"store_event": is_store_event(c("name"))},
        {"sitewide": says(c("title"), R.SITEWIDE) | (says(c("title"), R.EVERYTHING) & c("store_event"))})


# --- store ---

def leading_name(title: Column) -> tuple[Column, Column]:
    """The store a title starts with, before a possessive or a sale word within a few event words, and whether it is
    written as a possessive. "" when the words name an event or a department."""
    token = r"(?:[A-Z][\w&.!+-]*|[a-z]+[A-Z][\w&.!+-]*|&)"
    own = rf"^({token}(?:\s+{token}){{0,3}}?)'s?\s+(?:\S+\s+){{0,4}}?(?i:sales?|events?|deals|clearance|savings|promo(?:tion)?s?|specials|markdowns?|blowout|outlet)\b"
    plain = rf"^({token}(?:\s+{token}){{0,3}}?)\s+((?:\S+\s+){{0,4}}?)(?i:sales?|events?|deals|clearance|savings|promo(?:tion)?s?|specials|markdowns?|blowout|outlet)\b"

    # a title is cleaned and searched once; what no search finds is asked nothing more
    def read(t: Column) -> Column:
        before_sale = bind(F.regexp_extract(t, plain, 1), lambda p: F.when((p != "") & is_store_event(F.regexp_extract(t, plain, 2)), p).otherwise(""))
        return bind(F.regexp_extract(t, own, 1), lambda o: bind(F.struct(F.when(o != "", o).otherwise(before_sale).alias("name"), (o != "").alias("own")), judge))

    def judge(x: Column) -> Column:
        named = (x["name"] != "") & ~is_store_event(x["name"]) & ~says(x["name"], R.DEAL_SITES)
        return bind(named, lambda n: F.struct(F.when(n, x["name"]).otherwise("").alias("name"), (x["own"] & n).alias("own")))
    found = bind(without(straight(title), R.DECOR, ""), read)
    return found["name"], found["own"]


def jn_unknown_store(posts: DataFrame) -> DataFrame:
    """A store no registry lists, taken when a link leads to its own site or the post says it ships. Needs title, text,
    links. Adds store_name and store_how."""
    c = F.col
    name, possessive = leading_name(c("title"))
    key = fn_norm(F.regexp_replace(c("_name"), r"(?i)^the\s+", ""))
    labels = F.flatten(F.transform(F.flatten(F.transform(F.coalesce("links", F.array()), fn_hosts)), lambda h: F.split(h, r"\.")))
    own = bind(key, lambda k: (F.length(k) >= 3) & F.exists(labels, lambda x: (x == k) & ~x.isin(*R.HOST_WORDS)))
    ships = says(F.concat("title", F.lit(" "), F.coalesce("text", F.lit(""))), R.SHIPS)
    return staged(posts, ["store_name", "store_how"],
                  {"_name": name, "_poss": possessive},
                  {"_own": (c("_name") != "") & own, "_ships": (c("_name") != "") & ships},
                  {"store_name": F.when(c("_own") | c("_ships"), c("_name")).otherwise(""),
                   "store_how": F.when(c("_own"), "the title names it and the post links to its site")
                   .when(c("_ships"), "the title names it and the post says it ships").otherwise("")})
