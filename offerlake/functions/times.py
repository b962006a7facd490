"""Days and hours in a place's own zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import bind

ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def _read(raw: Column, use) -> Column:
    """`use` of a time's parts as stated: its day, hour, minute, whether it is in UTC, and the moment it is."""
    part = lambda r, g: F.regexp_extract(r, ISO, g)                                        # noqa: E731

    def known(p: Column) -> Column:
        zone = F.when(p["zone"] == "Z", F.lit("+00:00")).otherwise(p["zone"])
        at = F.concat(p["day"], F.lit(" "), p["hour"], F.lit(":"), p["minute"], F.lit(":"), F.when(p["sec"] == "", "00").otherwise(p["sec"]), zone)
        return F.struct(F.try_to_date(p["day"]).alias("day"), p["hour"].try_cast("int").alias("hour"), p["minute"].try_cast("int").alias("minute"),
                        zone.isin("+00:00", "+0000", "-00:00").alias("utc"), F.try_to_timestamp(at).alias("instant"))

    def parts(r: Column) -> Column:
        return F.when(r.rlike(ISO), F.struct(part(r, 1).alias("day"), part(r, 2).alias("hour"), part(r, 3).alias("minute"), part(r, 4).alias("sec"),
                                             part(r, 5).alias("zone")))
    return bind(raw, lambda r: bind(parts(r), lambda p: F.when(p.isNotNull(), bind(known(p), use))))


def instant(raw: Column) -> Column:
    """An ISO time with an offset as a moment; a time without one can't be placed, so it is null."""
    return _read(raw, lambda s: s["instant"])


def wall(day: Column, seconds: int, zone: Column) -> Column:
    """The moment a zone's clock shows `seconds` past midnight on a day."""
    return F.to_utc_timestamp(day.cast("timestamp") + F.expr(f"INTERVAL {seconds} SECONDS"), zone)


def fn_ad_end_local(raw: Column, zone: Column) -> Column:
    """The end of the day an ad names, in the place's zone. Ads state it as 23:59 in some other zone or as the small
    hours UTC of the next morning; anything else is the moment it says."""
    def end(s: Column) -> Column:
        return (F.when(s["utc"] & (s["hour"] < 12), wall(F.date_sub(s["day"], 1), 86399, zone))
                .when((s["hour"] == 23) & (s["minute"] == 59), wall(s["day"], 86399, zone)).otherwise(s["instant"]))
    return _read(raw, end)


def fn_ad_start_local(raw: Column, zone: Column) -> Column:
    """Midnight of the day an ad names, in the place's zone."""
    def start(s: Column) -> Column:
        named = (s["utc"] & s["hour"].between(3, 8)) | ((s["hour"] == 0) & (s["minute"] == 0))
        return F.when(named, wall(s["day"], 0, zone)).otherwise(s["instant"])
    return _read(raw, start)


def local_day(moment: Column, zone: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(moment, zone))


def days_between(a: Column, b: Column, zone: Column) -> Column:
    """Calendar days from a to b on the place's calendar."""
    return F.datediff(local_day(b, zone), local_day(a, zone))


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6


def fn_nearest_year(month: Column, day: Column, ref: Column) -> Column:
    """A month and day without a year: the year that puts it nearest the reference date, the earlier on a tie."""
    def near(x: Column) -> Column:
        def at(shift: int) -> Column:
            d = F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(x["ref"]) + shift, x["m"], x["d"]))
            return bind(d, lambda v: F.when(v.isNotNull(), F.struct(F.abs(F.datediff(v, x["ref"])).alias("off"), v.alias("day"))))
        return F.when(x["m"].isNotNull() & x["d"].isNotNull(), F.array_min(F.array(at(-1), at(0), at(1)))["day"])
    return bind(F.struct(month.alias("m"), day.alias("d"), ref.alias("ref")), near)


# Month and weekday names as offers write them.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
DAY_KEYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def month_number(name: Column) -> Column:
    """1 to 12 from a month's name; null for anything else."""
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    return F.nullif(at, F.lit(0)).cast("int")


def weekday_number(name: Column) -> Column:
    """0 Monday to 6 Sunday; null for anything else."""
    at = F.array_position(F.array(*[F.lit(d) for d in DAY_KEYS]), F.lower(F.substring(name, 1, 3)))
    return (F.nullif(at, F.lit(0)) - 1).cast("int")
