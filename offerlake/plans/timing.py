"""Queries of schedules and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cal
from .catalog import query
from .inputs import Tables, using
from .wording import case

START, END = "1998-06-01 15:00:00", "1998-06-08 15:00:00"          # Monday to Monday, 10 am in Chicago
SCHEDULES = """
    SELECT o_orderkey AS offer, o_orderkey % 7 AS d, CASE o_orderkey % 6 WHEN 4 THEN '1:1' WHEN 5 THEN 'd:' || (o_orderkey % 28 + 1) ELSE '' END AS monthly,
           CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE (o_orderkey % 24) * 3600 END AS a, CASE WHEN o_orderkey % 4 = 2 THEN NULL ELSE (o_orderkey % 12 + 8) * 3600 END AS b,
           o_orderkey % 4 > 0 AS timed, CAST(o_orderdate AS DATE) + 1500 AS until FROM orders"""


def schedules(t: Tables):
    k = F.col("o_orderkey")
    none = F.filter(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))), lambda x: F.lit(False))
    win = F.array(F.struct(F.when(k % 4 != 1, (k % 24) * 3600).cast("int").alias("a"), F.when(k % 4 != 2, (k % 12 + 8) * 3600).cast("int").alias("b")))
    monthly = F.when(k % 6 == 4, "1:1").when(k % 6 == 5, F.concat(F.lit("d:"), (k % 28 + 1).cast("string"))).otherwise("")
    return t.read("orders").select(k.alias("offer"), F.array((k % 7).cast("int"), ((k + 3) % 7).cast("int")).alias("days"), monthly.alias("monthly"),
                                   F.when(k % 4 > 0, win).otherwise(none).alias("windows"), F.lit("").alias("zone"), F.lit(None).cast("date").alias("since"),
                                   F.date_add(F.to_date("o_orderdate"), 1500).alias("until"))


DATES = """
    SELECT offer, day FROM (SELECT *, unnest(generate_series(DATE '1998-06-01', DATE '1998-06-08', INTERVAL 1 DAY))::DATE AS day FROM sched)
    WHERE day <= until AND CASE WHEN monthly = '1:1' THEN isodow(day) = 2 AND day(day) <= 7 WHEN monthly <> '' THEN day(day) = substr(monthly, 3)::INT
                                ELSE isodow(day) - 1 IN (d, (d + 3) % 7) END
      AND NOT (timed AND day = DATE '1998-06-01' AND coalesce(b <= 36000, false)) AND NOT (timed AND day = DATE '1998-06-08' AND coalesce(a >= 36000, false))"""


def dated(t: Tables):
    at = lambda x: F.lit(x).cast("timestamp")                                                      # noqa: E731
    return cal.tm_occurrences(schedules(t), at(START), at(END), F.lit("America/Chicago"))


@query("tm_occurrences", using(sched=SCHEDULES, body=f"SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(offer) AS BIGINT) AS checksum FROM ({DATES}) GROUP BY 1"))
def _(t: Tables):
    return dated(t).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("offer").alias("checksum"))


@query("tm_monthly_rule", """
    SELECT rule, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS checksum FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, unnest(['1:1', '3:5', '-1:4', 'd:7']) AS rule FROM orders)
    WHERE CASE rule WHEN '1:1' THEN isodow(d) = 2 AND day(d) <= 7 WHEN '3:5' THEN isodow(d) = 6 AND day(d) BETWEEN 15 AND 21
               WHEN '-1:4' THEN isodow(d) = 5 AND day(d) + 7 > day(last_day(d)) ELSE day(d) = 7 END GROUP BY rule""")
def _(t: Tables):
    rules = F.explode(F.array(*[F.lit(r) for r in ("1:1", "3:5", "-1:4", "d:7")]))
    d = t.read("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), rules.alias("rule"))
    return d.where(cal.tm_monthly_rule(F.col("d"), F.col("rule"))).groupBy("rule").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("checksum"))


@query("tm_zone_shift", """
    SELECT second, count(*) AS n FROM (SELECT CAST(epoch(l - date_trunc('day', l)) AS INTEGER) AS second FROM (
      SELECT timezone('America/Chicago', timezone('America/New_York', date_trunc('day', o_orderdate) + to_seconds((o_orderkey % 24) * 3600 + 900))) AS l FROM orders)) GROUP BY second""")
def _(t: Tables):
    sec = ((F.col("o_orderkey") % 24) * 3600 + 900).cast("int")
    shifted = cal.tm_zone_shift(sec, F.to_date("o_orderdate"), F.lit("America/New_York"), F.lit("America/Chicago"))
    return t.read("orders").select(shifted.alias("second")).groupBy("second").agg(F.count("*").alias("n"))


@query("tm_off_days", using(sched=SCHEDULES, body=f"""
    SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(offer) AS BIGINT) AS checksum FROM ({DATES}) WHERE NOT (offer % 5 = 0 AND day IN (DATE '1998-06-02', DATE '1998-06-05')) GROUP BY 1"""))
def _(t: Tables):
    off = t.read("orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("offer"), F.explode(F.array(*[F.lit(d).cast("date") for d in ("1998-06-02", "1998-06-05", "1998-06-05")])).alias("day"))
    d = cal.tm_off_days(dated(t), off)
    return d.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("offer").alias("checksum"))


@query("tm_recurring_promo", """
    SELECT strftime(least(d + ((o_orderkey % 7 - isodow(d) + 1 + 14) % 7)::INTEGER, d + ((2 - isodow(d) + 1 + 14) % 7)::INTEGER), '%Y-%m') AS month, count(*) AS n,
           CAST(sum(day(least(d + ((o_orderkey % 7 - isodow(d) + 1 + 14) % 7)::INTEGER, d + ((2 - isodow(d) + 1 + 14) % 7)::INTEGER))) AS BIGINT) AS days
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY 1""")
def _(t: Tables):
    nxt = cal.tm_recurring_promo(F.array((F.col("o_orderkey") % 7).cast("int"), F.lit(2)), F.to_date("o_orderdate"))
    d = t.read("orders").select(nxt.alias("d"))
    return d.groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum(F.dayofmonth("d")).cast("bigint").alias("days"))


@query("tm_show_until", using("posts", body="""
    SELECT strftime(least(coalesce(expires_at, posted_at + INTERVAL 7 DAY), posted_at + INTERVAL 30 DAY), '%Y-%m-%d %H') AS until, count(*) AS n FROM posts GROUP BY 1"""))
def _(t: Tables):
    d = cal.tm_show_until(t.posts.withColumn("ends_at", F.col("expires_at")))
    return d.groupBy(F.date_format("show_until", "yyyy-MM-dd HH").alias("until")).agg(F.count("*").alias("n"))


@query("tm_zone_variants", using("deals", body="""
    SELECT line, CAST(sum(epoch(timezone('America/Chicago', d)) + epoch(timezone('America/Chicago', e + INTERVAL 86399 SECOND))) AS BIGINT) AS central,
           CAST(sum(epoch(timezone('America/Denver', d)) + epoch(timezone('America/Denver', e + INTERVAL 86399 SECOND))) AS BIGINT) AS west, CAST(sum(epoch(timezone('UTC', e + INTERVAL 100799 SECOND))) AS BIGINT) AS gone,
           count(*) AS n FROM (SELECT line, valid_from AS d, valid_to AS e FROM deals) GROUP BY line"""))
def _(t: Tables):
    iso = lambda c, tail: F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit(tail))                   # noqa: E731
    d = cal.tm_zone_variants(t.deals.select("line", iso("valid_from", "T00:00:00-04:00").alias("valid_from"), iso("valid_to", "T23:59:59-04:00").alias("valid_to")))
    s = lambda *cs: F.sum(sum((F.unix_seconds(c) for c in cs), F.lit(0)))                         # noqa: E731
    return d.groupBy("line").agg(s("vf", "vt").alias("central"), s("vf_west", "vt_west").alias("west"), s("gone").alias("gone"), F.count("*").alias("n"))


@query("job_schedule_reading", using("deals", body="""
    SELECT days, a, b, zone, u, recurring, count(*) AS n FROM (SELECT CASE line WHEN 1 THEN '0,1,2,3,4' WHEN 2 THEN '1,3' WHEN 3 THEN '0,1,2,3,4,6' WHEN 4 THEN '0,1,2,3,4,5,6' WHEN 5 THEN '5,6' WHEN 6 THEN '4' ELSE '' END AS days,
      CASE line WHEN 1 THEN 14 * 3600 WHEN 2 THEN (size % 6 + 12) * 3600 WHEN 3 THEN 10 * 3600 WHEN 6 THEN 21 * 3600 END AS a, CASE line WHEN 1 THEN 17 * 3600 WHEN 3 THEN 14 * 3600 WHEN 4 THEN 43200 END AS b,
      CASE line WHEN 2 THEN 'America/New_York' ELSE '' END AS zone, CASE line WHEN 5 THEN size % 28 + 1 WHEN 6 THEN 30 END AS u, line IN (1, 2, 4, 5) AS recurring FROM deals) GROUP BY ALL"""))
def _(t: Tables):
    hour = F.when(F.col("size") % 6 == 0, 12).otherwise(F.col("size") % 6).cast("string")
    text = case("line", F.lit("Half price Mondays through Fridays from 2-5PM."), F.concat(F.lit("$5 tacos on Tuesdays and Thursdays after "), hour, F.lit(":00 p.m. ET")),
                F.lit("$3 beers Sun - Fri, 10-2 pm"), F.lit("Kids eat free every day until noon"), F.concat(F.lit("Every weekend through Sept. "), (F.col("size") % 28 + 1).cast("string")),
                F.lit("Fridays? No: Friday 9 pm - 2 am in September"), F.lit("Ruby Tuesday has pies"))
    text = F.when(F.col("line") == 6, "Wings on Friday, 9 pm - 2 am in September").otherwise(text)
    d = cal.job_schedule_reading(t.spread_deals.select("line", text.alias("text"), F.lit("1998-09-10").cast("date").alias("ref_date")))
    w = F.get("windows", 0)
    return d.select(F.array_join("days", ",").alias("days"), w["a"].alias("a"), w["b"].alias("b"), "zone", F.dayofmonth("until").alias("u"), "recurring").groupBy(
        "days", "a", "b", "zone", "u", "recurring").agg(F.count("*").alias("n"))


@query("dq_schedule", using(sched=SCHEDULES, body=f"""
    WITH due AS ({DATES}),
    shown AS (SELECT offer, day FROM due WHERE offer % 10 <> 0 OR isodow(day) <> 1 UNION SELECT offer, DATE '1998-06-03' FROM sched WHERE offer % 11 = 0 AND until >= DATE '1998-06-03')
    SELECT verdict, missing, extra, count(*) AS n FROM (SELECT coalesce(d.offer, s.offer) AS offer, count(*) FILTER (WHERE s.day IS NULL) AS missing, count(*) FILTER (WHERE d.day IS NULL) AS extra,
      CASE WHEN count(*) FILTER (WHERE s.day IS NULL OR d.day IS NULL) > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM due d FULL JOIN shown s ON d.offer = s.offer AND d.day = s.day GROUP BY 1) GROUP BY ALL"""))
def _(t: Tables):
    s = schedules(t)
    calendar = t.spark.range(8).select(F.date_add(F.lit("1998-06-01").cast("date"), F.col("id").cast("int")).alias("day"))
    local = lambda x: F.from_utc_timestamp(F.lit(x).cast("timestamp"), F.lit("America/Chicago"))     # noqa: E731
    real = dated(t).where("offer % 10 <> 0 OR weekday(day) <> 0").select("offer", "day")
    false = s.where("offer % 11 = 0 AND until >= DATE '1998-06-03'").select("offer", F.lit("1998-06-03").cast("date").alias("day"))
    return cal.dq_schedule(s, real.union(false).distinct(), calendar, local(START), local(END)).groupBy("verdict", "missing", "extra").agg(F.count("*").alias("n"))
