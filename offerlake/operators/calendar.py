"""Schedules expanded to dates, read from wording, and compared with a calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import bind
from ..functions.times import MONTH, month_number, weekday_number
from ..functions import fn_nearest_year
from ..rules import wordings as R
from .wordwork import ci, got, matches, says, without


def tm_monthly_rule(day: Column, rule: Column) -> Column:
    """Whether a date is the one a monthly rule names: "1:1" the first Tuesday, "-1:4" the last Friday, "d:7" the 7th."""
    kind, n = F.split_part(rule, F.lit(":"), F.lit(1)), F.split_part(rule, F.lit(":"), F.lit(2)).try_cast("int")
    last = F.dayofmonth(day) + 7 > F.dayofmonth(F.last_day(day))
    nth = F.floor((F.dayofmonth(day) - 1) / 7) + 1
    return F.when(kind == "d", F.dayofmonth(day) == n).otherwise(
        (F.weekday(day) == n) & F.when(kind == "-1", last).otherwise(nth == kind.try_cast("int")))


def tm_zone_shift(second: Column, day: Column, source: Column, target: Column) -> Column:
    """A time of day stated in one zone, on a date, as the target zone's clock shows it (seconds of the day); null stays
    open."""
    moment = F.to_utc_timestamp(day.cast("timestamp") + F.make_dt_interval(secs=second), source)
    local = F.from_utc_timestamp(moment, target)
    return F.when(second.isNotNull(), F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)).cast("int")


def runs_on(day: Column, days: Column, monthly: Column, since: Column, until: Column) -> Column:
    inside = F.coalesce(day >= since, F.lit(True)) & F.coalesce(day <= until, F.lit(True))
    return inside & F.when(F.coalesce(monthly, F.lit("")) != "", tm_monthly_rule(day, monthly)).otherwise(F.array_contains(days, F.weekday(day).cast("int")))


def occurrences(days: Column, monthly: Column, windows: Column, zone: Column, since: Column, until: Column, start: Column, end: Column, tz: Column) -> Column:
    """The dates in the window on which a schedule runs and is not over at its start nor still to begin at its end. `start`
    and `end` are moments; their days and times are the place's."""
    s, e = F.from_utc_timestamp(start, tz), F.from_utc_timestamp(end, tz)
    clock = lambda x: F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)                           # noqa: E731

    def counts(x: Column) -> Column:
        def keep(d: Column) -> Column:
            shift = lambda v: F.when((F.coalesce(zone, F.lit("")) != ""), tm_zone_shift(v, d, zone, tz)).otherwise(v)
            some = F.size(windows) > 0
            over = (d == x["d0"]) & some & ~F.exists(windows, lambda w: F.coalesce(shift(w["b"]) > x["t0"], F.lit(True)))
            not_yet = (d == x["d1"]) & some & ~F.exists(windows, lambda w: F.coalesce(shift(w["a"]) < x["t1"], F.lit(True)))
            return runs_on(d, days, monthly, since, until) & ~over & ~not_yet
        return F.filter(F.sequence(x["d0"], x["d1"], F.expr("INTERVAL 1 DAY")), keep)
    return bind(F.struct(F.to_date(s).alias("d0"), F.to_date(e).alias("d1"), clock(s).alias("t0"), clock(e).alias("t1")), counts)


def tm_occurrences(offers: DataFrame, start: Column, end: Column, tz: Column) -> DataFrame:
    """One row per offer and date it runs in the window. Needs days, monthly, windows, zone, since, until."""
    c = F.col
    dates = occurrences(c("days"), c("monthly"), c("windows"), c("zone"), c("since"), c("until"), start, end, tz)
    return offers.withColumn("day", F.explode(dates))


def tm_off_days(dates: DataFrame, off: DataFrame) -> DataFrame:
    """Dates a page marks as sold out taken away. Needs offer, day on both."""
    return dates.join(off.select("offer", "day").distinct(), ["offer", "day"], "left_anti")


def tm_recurring_promo(days: Column, start: Column) -> Column:
    """The next of some weekdays on or after a date."""
    return F.array_min(F.transform(days, lambda d: F.date_add(start, F.pmod(d - F.weekday(start), F.lit(7)).cast("int"))))


def tm_show_until(offers: DataFrame, posted_days: int = 30, undated_days: int = 7) -> DataFrame:
    """The last moment an offer may be shown: its end, so long after it was posted, sooner where it states no end. Needs
    ends_at, posted_at."""
    p = F.col("posted_at")
    return offers.withColumn("show_until", F.least("ends_at", p + F.make_dt_interval(F.lit(posted_days)),
                                                   F.when(F.col("ends_at").isNull(), p + F.make_dt_interval(F.lit(undated_days)))))


def tm_zone_variants(ads: DataFrame, zones: tuple[str, str] = ("America/Chicago", "America/Denver")) -> DataFrame:
    """An ad's first and last moment in both zones, and the moment the source withdraws it where that is sooner. Needs
    valid_from, valid_to as stated."""
    from ..functions import fn_ad_end_local, fn_ad_start_local
    from ..functions.times import instant
    a, b = F.lit(zones[0]), F.lit(zones[1])
    df = ads.withColumns({"vf": fn_ad_start_local(F.col("valid_from"), a), "vt": fn_ad_end_local(F.col("valid_to"), a), "_f": fn_ad_start_local(F.col("valid_from"), b),
                          "_t": fn_ad_end_local(F.col("valid_to"), b), "_at": instant(F.col("valid_to"))})
    return df.withColumns({"vf_west": F.when(F.col("_f") != F.col("vf"), F.col("_f")), "vt_west": F.when(F.col("_t") != F.col("vt"), F.col("_t")),
                           "gone": F.when(F.col("_at") < F.greatest("vt", "_t"), F.col("_at"))}).drop("_f", "_t", "_at")


# --- wording ---
# Weekdays, hours and end dates as offers write them.
_FULL = r"(mon|tues|wednes|thurs|fri|satur|sun)days?"
_ABBR = r"(mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:days?)?\.?"
DAY_RANGE = r"\b" + _ABBR + r"\s*(?:-|–|—|to|through|thru)\s*" + _ABBR + r"(?![a-z])"
DAY_NAME = r"\b" + _FULL + r"\b"
ALL_BUT = r"\bevery ?day (?:but|except)\s+((?:" + _FULL + r"(?:\s*(?:,|and|or)\s*)?)+)"
EVERY_DAY = r"\bevery ?day\b|\bdaily\b|\ball week\b|\b(?:7|seven) days a week\b|\bevery single day\b"
NOT_A_DAY = (r"\bruby tuesday'?s?\b|\bt\.?g\.?i\.? ?friday'?s\b|\btuesday morning\b|\bwednesday addams\b|\bblack friday\b|\bgood friday\b|\bcyber monday\b|"
             r"\beaster sunday\b|\bsuper bowl sunday\b|\bash wednesday\b|\bfat tuesday\b|\bgiving tuesday\b|\bsunday ticket\b|"
             r"\b(?:monday|thursday|sunday) night football\b|\bfriday the 13th\b|\bsmall business saturday\b")
_T, _AP = r"(\d{1,2})(?::(\d{2}))?", r"(a\.?\s?m\.?|p\.?\s?m\.?)"
_ZONE = r"(?:\s*\(?\b([pmce])[sd]?t\b\)?)?"
_ENDWORD = r"(noon|midnight|close|closing)"
TIME_RANGE = (r"(?<![\d$.:/])(?:" + _T + r"\s*" + _AP + r"?|(open|opening|noon))\s*(?:-|–|—|to|until|till|'?til)\s*(?:" + _T + r"\s*" + _AP + r"|" + _ENDWORD + r")" + _ZONE)
AFTER = r"\b(?:after|from|starting at|beginning at|starts at)\s+(?:" + _T + r"\s*" + _AP + r"|(noon))" + _ZONE
UNTIL_TIME = r"\b(?:until|till|'?til|before|ends at)\s+(?:" + _T + r"\s*" + _AP + r"|" + _ENDWORD + r")" + _ZONE
ZONES = {"p": "America/Los_Angeles", "m": "America/Denver", "c": "America/Chicago", "e": "America/New_York"}
_THROUGH = r"\b(?:through|thru|until|till|'?til|ends?|ending|expires?|expiring|valid (?:through|thru|until)|good through)"
LAST_MD = _THROUGH + r"\s+(?:(?:" + _FULL + r"),?\s+)?" + MONTH + r"\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s*(20\d\d))?"
LAST_NUM = _THROUGH + r"\s+(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?"
LAST_MONTH = _THROUGH + r"\s+(?:the end of\s+)?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b(?!\.?\s*\d)"
IN_MONTH = (r"\b(?:in|all|during|throughout|this|for the month of|all of)\s+(january|february|march|april|may|june|july|august|september|october|november|december)\b(?!\s*\d)")
# Words, in lower case, of which every match has one, for the patterns that they are not read from (`rules.signs`).
R.MORE_WORDS.update({DAY_RANGE: ["-", "–", "—", "to", "thr"], TIME_RANGE: ["-", "–", "—", "to", "til"], NOT_A_DAY: ["friday", "ruby tuesday", "tuesday morning", "wednesday addams", "cyber monday", "easter sunday", "super bowl", "ash wednesday",
                                 "fat tuesday", "giving tuesday", "sunday ticket", "night football", "small business"],
                     IN_MONTH: ["uary", "march", "april", "may", "june", "july", "august", "ber"]})


def _seq(a: Column, b: Column) -> Column:
    """The days from a through b, over Sunday where needed."""
    return F.transform(F.sequence(F.lit(0), F.pmod(b - a, F.lit(7))), lambda k: F.pmod(a + k, F.lit(7)).cast("int"))


def weekdays_in(text: Column, every_day: bool = True) -> Column:
    """Every weekday a sentence names, ranges and exceptions included, as a sorted array; `every_day` lets "daily" name
    them all."""
    week = F.array(*[F.lit(d) for d in range(7)])
    none = F.array().cast("array<int>")

    def read(t: Column) -> Column:
        but = got(t, ALL_BUT, 1)
        spared = F.transform(matches(but, DAY_NAME), weekday_number)
        first = F.when(but.isNotNull(), F.array_except(week, spared)).otherwise(none)
        return bind(without(t, ALL_BUT), lambda r: F.struct(first.alias("first"), r.alias("rest")))

    def more(x: Column) -> Column:
        t = x["rest"]
        spans = F.flatten(F.transform(matches(t, DAY_RANGE), lambda m: _seq(weekday_number(F.regexp_extract(m, ci(DAY_RANGE), 1)), weekday_number(F.regexp_extract(m, ci(DAY_RANGE), 2)))))
        return bind(without(t, DAY_RANGE), lambda rest: F.concat(
            x["first"], spans, F.transform(matches(rest, DAY_NAME), weekday_number), F.when(says(rest, r"\bweekdays?\b"), F.array(*[F.lit(d) for d in range(5)])).otherwise(none),
            F.when(says(rest, r"\bweekends?\b"), F.array(F.lit(5), F.lit(6))).otherwise(none)))

    def close(t: Column) -> Column:
        found = bind(read(t), more)
        whole = F.when(says(t, EVERY_DAY), week).otherwise(none) if every_day else none
        return bind(found, lambda f: F.array_sort(F.array_distinct(F.when(F.size(f) > 0, f).otherwise(whole))))
    return bind(without(F.coalesce(text, F.lit("")), NOT_A_DAY), close)


def _clock(hour: Column, minute: Column, half: Column) -> Column:
    h, m = hour.try_cast("int"), F.coalesce(minute.try_cast("int"), F.lit(0))
    return F.when(h.between(1, 12) & (m <= 59), (h % 12 + F.when(F.lower(half).startswith("p"), 12).otherwise(0)) * 3600 + m * 60)


def _word_clock(word: Column) -> Column:
    w = F.lower(word)
    return F.when(w == "noon", 12 * 3600).when(w == "midnight", 23 * 3600 + 59 * 60)


def time_windows(text: Column) -> Column:
    """struct(windows, zone): the hours a text states, as struct(a, b) seconds of the day with null for open. A time counts
    only with am or pm attached."""
    t = F.coalesce(text, F.lit(""))
    win = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))              # noqa: E731

    def span(m: Column) -> Column:
        g = lambda i: F.nullif(F.regexp_extract(m, ci(TIME_RANGE), i), F.lit(""))                 # noqa: E731
        end = F.when(g(5).isNotNull(), _clock(g(5), g(6), g(7))).otherwise(_word_clock(g(8)))
        raw = F.when(g(4).isNotNull(), _word_clock(g(4))).otherwise(_clock(g(1), g(2), F.coalesce(g(3), g(7), F.lit("pm"))))

        def settle(x: Column) -> Column:
            # "10-2 pm" is 10 am to 2 pm
            a = F.when(x["guess"] & (x["a"] >= x["b"]) & (x["a"] >= 12 * 3600), x["a"] - 12 * 3600).otherwise(x["a"])
            ok = ~(x["bad_end"] | (x["a"].isNull() & ~x["word"]) | (x["a"].isNull() & x["b"].isNull()))
            return F.when(ok, bind(a, lambda s: win(s, F.when(s.isNull() | (x["b"] > s), x["b"]))))
        return bind(F.struct(raw.alias("a"), end.alias("b"), (g(4).isNull() & g(3).isNull()).alias("guess"), g(4).isNotNull().alias("word"),
                             (g(5).isNotNull() & end.isNull()).alias("bad_end")), settle)

    def lone(rx: str, is_start: bool):
        def one(m: Column) -> Column:
            g = lambda i: F.nullif(F.regexp_extract(m, ci(rx), i), F.lit(""))                     # noqa: E731
            when = F.when(g(1).isNotNull(), _clock(g(1), g(2), g(3))).otherwise(_word_clock(g(4)))
            none = F.lit(None).cast("int")
            return bind(when, lambda w: F.when(w.isNotNull(), win(w, none) if is_start else win(none, w)))
        return one

    def gather(rest: Column) -> Column:
        # a range's words are taken out before single times are read, so "from 2-5 pm" is read once
        ranges = F.array_compact(F.transform(matches(t, TIME_RANGE), span))
        all_ = F.array_distinct(F.concat(ranges, F.array_compact(F.transform(matches(rest, AFTER), lone(AFTER, True))),
                                         F.array_compact(F.transform(matches(rest, UNTIL_TIME), lone(UNTIL_TIME, False)))))
        def name(zone: Column) -> Column:
            named = F.lit("")
            for k, z in ZONES.items():
                named = F.when(zone == k, z).otherwise(named)
            return named
        zone = bind(F.lower(F.coalesce(got(t, TIME_RANGE, 9), got(t, AFTER, 5), got(t, UNTIL_TIME, 5))), name)

        def join(w: Column) -> Column:
            one, two = F.get(w, 0), F.get(w, 1)
            merged = (F.size(w) == 2) & one["b"].isNull() & two["a"].isNull() & (one["a"] < two["b"])
            return F.struct(F.when(merged, F.array(win(one["a"], two["b"]))).otherwise(w).alias("windows"), zone.alias("zone"))
        return bind(all_, join)
    return bind(without(t, TIME_RANGE, " ; "), gather)


def last_day(text: Column, ref: Column) -> Column:
    """The last day an offer runs, when its wording gives one: the first stated end, else the end of a month it names."""
    t = F.coalesce(text, F.lit(""))
    p = lambda m, rx, i: F.nullif(F.regexp_extract(m, ci(rx), i), F.lit(""))                       # noqa: E731
    int_ = lambda x: x.try_cast("int")                                                              # noqa: E731

    def dated(month: Column, day: Column, year: Column) -> Column:
        y = F.when(year < 100, 2000 + year).otherwise(year)
        exact = F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day))
        return F.when(year.isNotNull(), exact).otherwise(fn_nearest_year(month, day, ref))

    def md(m: Column) -> Column:
        return dated(month_number(p(m, LAST_MD, 2)), int_(p(m, LAST_MD, 3)), int_(p(m, LAST_MD, 4)))

    def num(m: Column) -> Column:
        mo, dy = int_(p(m, LAST_NUM, 1)), int_(p(m, LAST_NUM, 2))
        return F.when(mo.between(1, 12) & dy.between(1, 31), dated(mo, dy, int_(p(m, LAST_NUM, 3))))

    def end_of(name: Column) -> Column:
        return F.last_day(fn_nearest_year(month_number(name), F.lit(1), ref))
    either = f"(?:{LAST_MD})|(?:{LAST_NUM})"
    stated = F.array_compact(F.transform(matches(t, either), lambda m: F.when(m.rlike(ci(LAST_MD)), md(m)).otherwise(num(m))))
    months = F.array_compact(F.concat(
        F.transform(matches(t, LAST_MONTH), lambda m: end_of(p(m, LAST_MONTH, 1))),
        F.transform(F.filter(matches(t, IN_MONTH), lambda m: ~(F.lower(m).endswith("may") & ~m.rlike(r"(?i)\b(?:in|during|throughout|all of) may\b"))), lambda m: end_of(p(m, IN_MONTH, 1)))))
    return bind(stated, lambda s: F.when(F.size(s) > 0, F.get(s, 0)).otherwise(F.array_max(months)))


def says_recurring(text: Column) -> Column:
    return says(without(F.coalesce(text, F.lit("")), NOT_A_DAY), r"\bevery\b|\beach (?:week|mon|tues|wednes|thurs|fri|satur|sun)|\bweekly\b|\b(?:mon|tues|wednes|thurs|fri|satur|sun)days\b")


def job_schedule_reading(texts: DataFrame) -> DataFrame:
    """Weekdays, hours, zone and last day a wording states. Needs text, ref_date (when the page was written)."""
    df = texts.withColumns({"days": weekdays_in(F.col("text")), "_w": time_windows(F.col("text")), "until": last_day(F.col("text"), F.col("ref_date"))})
    return df.withColumns({"windows": F.col("_w.windows"), "zone": F.col("_w.zone"), "recurring": says_recurring(F.col("text"))}).drop("_w")


def dq_schedule(offers: DataFrame, shown: DataFrame, calendar: DataFrame, start: Column, end: Column) -> DataFrame:
    """Whether the dates shown for each offer are those of an independent calendar: (offer, missing, extra, verdict). Needs offers(offer, days,
    monthly, windows, until), shown(offer, day), calendar(day) from the day of `start` to that of `end`, local moments.

    A day of the calendar says which weekday it is and which monthly rules name it, and offers meet it by these; hours that are over at the start
    or have not begun at the end take the first or the last day away."""
    c = F.col
    wd = F.weekday("day").cast("string")
    nth = F.concat((F.floor((F.dayofmonth("day") - 1) / 7) + 1).cast("string"), F.lit(":"), wd)
    last = F.when(F.month(F.date_add("day", 7)) != F.month("day"), F.concat(F.lit("-1:"), wd))
    day_of = calendar.select("day", F.explode(F.array_compact(F.array(F.concat(F.lit("w:"), wd), F.concat(F.lit("d:"), F.dayofmonth("day").cast("string")), nth, last))).alias("rule"))
    monthly = F.coalesce("monthly", F.lit(""))
    asked = offers.select("offer", "until", "windows", F.explode(F.when(monthly != "", F.array(monthly)).otherwise(F.transform("days", lambda d: F.concat(F.lit("w:"), d.cast("string"))))).alias("rule")).distinct()
    clock = lambda t: F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)                            # noqa: E731
    timed = F.size("windows") > 0
    over = timed & (c("day") == F.to_date(start)) & F.forall("windows", lambda w: F.coalesce(w["b"] <= clock(start), F.lit(False)))
    not_yet = timed & (c("day") == F.to_date(end)) & F.forall("windows", lambda w: F.coalesce(w["a"] >= clock(end), F.lit(False)))
    due = asked.join(day_of, "rule").where((c("until").isNull() | (c("day") <= c("until"))) & ~over & ~not_yet).select("offer", "day", F.lit(1).alias("due"), F.lit(0).alias("shown"))
    both = due.unionByName(shown.select("offer", "day", F.lit(0).alias("due"), F.lit(1).alias("shown"))).groupBy("offer", "day").agg(F.max("due").alias("due"), F.max("shown").alias("shown"))
    n = both.groupBy("offer").agg(F.count_if(F.expr("due = 1 AND shown = 0")).alias("missing"), F.count_if(F.expr("due = 0 AND shown = 1")).alias("extra"))
    return n.withColumn("verdict", F.when(F.expr("missing + extra > 0"), "fail").otherwise("pass"))
