"""Tables that are added to or replaced by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def latest(stored: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of both, the new one where a key is in both; of several new ones the last by `order`, and of those that tie the greatest by
    all fields."""
    rest = [c for c in stored.columns if c not in key]
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.select(*stored.columns).withColumn("_new", F.lit(1)))
    first = [c for c in order if c in rest]
    best = both.groupBy(*key).agg(F.max(F.struct("_new", *first, *[c for c in rest if c not in first])).alias("b"))
    return best.select(*key, *[F.col(f"b.{c}").alias(c) for c in rest]).select(*stored.columns)


def snk_verdicts(stored: DataFrame, new: DataFrame, order: Sequence[str] = ("tested_at",)) -> DataFrame:
    """Verdicts with a run's repeated tests replaced, the last by `order`. Needs run, test and the same columns on both."""
    return latest(stored, new, ["run", "test"], order)


def snk_snapshot(df: DataFrame, path: str, by: Sequence[str], defaults: dict | None = None, files: int = 1) -> None:
    """A partitioned JSON snapshot; fields that hold their default are left out. One shuffle by the partition and a hash of the row
    gives each partition `files` files, however many tasks held its rows; what is too much for one task by its measured size is split
    over several, a file each."""
    out = df
    for c, v in (defaults or {}).items():
        out = out.withColumn(c, F.when(~F.col(c).eqNullSafe(F.lit(v)), F.col(c)))
    out = out.withColumn("_file", F.pmod(F.xxhash64(*df.columns), F.lit(files))).hint("rebalance", *by, "_file").drop("_file")
    out.write.mode("overwrite").partitionBy(*by).option("ignoreNullFields", "true").json(path)


def snk_price_obs(points: DataFrame, path: str, now: Column) -> None:
    """Observed prices appended, partitioned by day so that history and retention read few files."""
    points.withColumns({"observed_at": now, "day": F.to_date(now)}).write.mode("append").partitionBy("day").parquet(path)


def snk_label_upsert(stored: DataFrame, new: DataFrame, now: Column, days: int = 60) -> tuple[DataFrame, DataFrame]:
    """(examples after the upsert, how many were new). The latest wins; what was not seen for `days` is forgotten. Needs key, source,
    words, categories, seen_at."""
    after = latest(stored, new, ["key"], ["seen_at"]).where(F.col("seen_at") >= now - F.make_dt_interval(F.lit(days)))
    added = new.select("key").distinct().join(stored.select("key"), "key", "left_anti").agg(F.count("*").alias("new"))
    return after, added


def follow(roots: DataFrame, steps: DataFrame, on: Sequence[str], to: str) -> DataFrame:
    """All nodes that can be reached from `roots` (columns `on`) by `steps`, which lead from the node `on` to the node whose last column is
    `to` instead. A step is doubled each round, so a path takes as many rounds as the logarithm of its length; each round is checkpointed."""
    *group, node = on
    reached, jump = cut(roots.select(*on).distinct()), cut(steps.select(*on, to))
    while not jump.isEmpty():
        ahead = reached.join(jump, list(on)).select(*group, F.col(to).alias(node))
        reached = cut(reached.unionByName(ahead).distinct())
        second = jump.select(*group, F.col(node).alias(to), F.col(to).alias("_far"))
        jump = cut(jump.join(second, [*group, to]).select(*on, F.col("_far").alias(to)))
    return reached


def snk_read_log(stored: DataFrame, new: DataFrame, gap_s: int = 3600) -> DataFrame:
    """The new reads worth keeping, with all their columns: a read is left out if the last read kept has the same result and is less than
    `gap_s` before it. Needs key, checked_at, found. The last stored read of a key is kept already; a new read that is not after it is
    compared with it alone. Reads of one key and time count once.

    No key is one group. Time is cut into slots as wide as the gap, so what concerns a read lies in its own slot and the next two, which are
    met by equi-joins on (key, slot). A read with no read within the gap before it, or with another result than that, is always kept. After
    any other kept read comes the first read a gap later, unless one of those lies between: each read has one successor, and the kept reads are
    those that can be reached (`follow`)."""
    gap, t = gap_s * 1_000_000, F.unix_micros("checked_at")
    last = stored.groupBy("key").agg(F.max(F.struct(t.alias("t"), "found")).alias("l")).select("key", F.col("l.t").alias("_last"), F.col("l.found").alias("_said"))
    rest = [c for c in new.columns if c not in ("key", "checked_at")]
    once = cut(new.groupBy("key", "checked_at").agg(F.max(F.struct(*rest)).alias("_r")).withColumn("t", t).join(last, "key", "left"))
    late = F.coalesce(F.col("t") <= F.col("_last"), F.lit(False))
    late_kept = once.where(late & (~F.col("_r.found").eqNullSafe(F.col("_said")) | (F.col("_last") - F.col("t") >= gap)))
    # the reads after the last stored one, and that one where it can matter
    after = once.where(~late)
    old = after.where(F.col("t") - F.col("_last") < gap).select("key", F.col("_last").alias("t"), F.col("_said").alias("found")).distinct()
    reads = after.select("key", "t", F.col("_r.found").alias("found")).unionByName(old).withColumn("slot", F.floor(F.col("t") / gap))
    in_slot = Window.partitionBy("key", "slot").orderBy("t")
    ends = reads.groupBy("key", "slot").agg(F.max(F.struct("t", "found")).alias("_end")).withColumn("slot", F.col("slot") + 1)
    before = F.coalesce(F.lag(F.struct("t", "found")).over(in_slot), F.col("_end"))
    opened = reads.join(ends, ["key", "slot"], "left").withColumn("_before", before)
    reads = cut(opened.select("key", "slot", "t", (F.col("_before").isNull() | (F.col("t") - F.col("_before.t") >= gap) | ~F.col("_before.found").eqNullSafe(F.col("found"))).alias("opens")))

    # the first read, and the first that opens, at or after a time: in the time's slot by a pass from its end, else in the next slots
    at = lambda slot, time, asks: reads.select("key", slot.alias("slot"), time.alias("at"), F.lit(asks).alias("asks"), "t", F.when(F.lit(asks == 1), F.col("opens")).alias("opens"))
    rows = at(F.col("slot"), F.col("t"), 0).unionByName(at(F.col("slot"), F.col("t"), 1)).unionByName(at(F.col("slot") + 1, F.col("t") + gap, 2))    # after t; the reads; from t and a gap on
    from_end = Window.partitionBy("key", "slot").orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({"_first": F.last(F.when(F.col("asks") == 1, F.col("at")), ignorenulls=True).over(from_end),
                             "_open": F.last(F.when(F.col("opens"), F.col("at")), ignorenulls=True).over(from_end)}).where("asks <> 1")
    firsts = reads.groupBy("key", "slot").agg(F.min("t").alias("f"), F.min(F.when(F.col("opens"), F.col("t"))).alias("o"))
    nth = lambda n: firsts.select("key", (F.col("slot") - n).alias("slot"), F.col("f").alias(f"f{n}"), F.col("o").alias(f"o{n}"))
    seen = seen.join(nth(1), ["key", "slot"], "left").join(nth(2), ["key", "slot"], "left")
    by_read = seen.groupBy("key", "t").agg(F.min(F.when(F.col("asks") == 0, F.coalesce("_open", "o1", "o2"))).alias("opening"), F.min(F.when(F.col("asks") == 2, F.coalesce("_first", "f1"))).alias("next"))
    steps = by_read.where("next IS NOT NULL AND (opening IS NULL OR opening > next)").select("key", "t", "next")
    kept = after.join(follow(reads.where("opens"), steps, ["key", "t"], "next"), ["key", "t"], "left_semi")
    return kept.unionByName(late_kept).select("key", "checked_at", "_r.*").select(*new.columns)
