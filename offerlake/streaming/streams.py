"""The polling of sources as streams: posts seen once, prices over time, reads, examples and sales that are live now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import flt_sale_live
from ..session import cut
from ..sources.sinks import latest, snk_label_upsert, snk_read_log
from .buckets import BucketLog


def stm_post_dedupe(stream: DataFrame, late: str = "3 days") -> DataFrame:
    """One post seen in many polls, once. Needs id, posted_at."""
    return stream.withWatermark("posted_at", late).dropDuplicatesWithinWatermark(["id"])


def stm_price_windows(stream: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Lowest and average price per product in tumbling or sliding windows. Needs product, price, observed_at."""
    w = F.window("observed_at", width, slide) if slide else F.window("observed_at", width)
    return (stream.withWatermark("observed_at", late).groupBy(w.alias("w"), "product")
            .agg(F.min("price").alias("lowest"), F.avg("price").alias("average"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "product", "lowest", "average", "n"))


def stm_read_log(stream: DataFrame, path: str, gap_s: int = 3600, buckets: int = 64):
    """A writer that keeps the reads worth keeping: not within the gap of the last one kept with the same result. The kept reads are at `path`
    /kept, one folder a batch; the last one of each key is a bucketed table at `path`/last. A batch's reads are settled among themselves and
    against that table as a stored log is (`snk_read_log`), so no key is one group however many of the batch's reads it has; a read that comes
    late is compared with the key's last one alone. Needs key, checked_at, found (not null)."""
    last = BucketLog(stream.sparkSession, f"{path}/last", stream.select("key", "checked_at", "found").schema, ["key"], buckets)

    def keep(batch: DataFrame, n: int) -> None:
        reads = cut(batch.select("key", "checked_at", "found"))
        stored = last.table(last.manifest(n)).join(reads.select("key").distinct(), "key", "left_semi")
        kept = cut(snk_read_log(stored, reads, gap_s))
        kept.write.mode("overwrite").parquet(f"{path}/kept/batch={n}")
        newest = lambda df: df.groupBy("key").agg(F.max(F.struct("checked_at", "found")).alias("l")).select("key", "l.*")
        last.merge(newest(kept), n, lambda old, new: newest(old.unionByName(new)))
    return stream.writeStream.foreachBatch(keep)


def stm_label_upsert(stream: DataFrame, path: str, now: Column, days: int = 60, buckets: int = 64):
    """A writer that upserts each batch of examples into a bucketed table: a batch rewrites the buckets of its keys, and a batch tried again
    writes the same. Needs key, source, words, categories, seen_at. `label_table` reads it."""
    log = BucketLog(stream.sparkSession, path, stream.schema, ["key"], buckets)

    def upsert(batch: DataFrame, n: int) -> None:
        one = latest(batch.limit(0), batch, ["key"], ["seen_at"])
        log.merge(one, n, lambda stored, new: snk_label_upsert(stored, new, now, days)[0])
    return stream.writeStream.foreachBatch(upsert)


def label_table(log: BucketLog, now: Column, days: int = 60) -> DataFrame:
    """The examples of a bucketed table seen in the last `days`; what a bucket holds beyond that goes when the bucket is next written."""
    return log.table().where(F.col("seen_at") >= now - F.make_dt_interval(F.lit(days)))


def stm_live_set(stream: DataFrame, path: str, now: Column, buckets: int = 64):
    """A writer that keeps the table of sales live at `now`, bucketed by id. A post that comes again, in the same batch or a later one, replaces
    what was known of it, so a corrected end counts; of several in a batch the last posted. `live_table` reads it at a
    later moment. Needs id, posted_at, starts_at, ends_at."""
    log = BucketLog(stream.sparkSession, path, stream.schema, ["id"], buckets)

    def merge(batch: DataFrame, n: int) -> None:
        live = lambda df: flt_sale_live(df, now).where("reason IS NULL").drop("reason")
        log.merge(batch, n, lambda stored, new: live(latest(stored, new, ["id"], ["posted_at"])))
    return stream.writeStream.foreachBatch(merge)


def live_table(log: BucketLog, now: Column) -> DataFrame:
    """The sales of a bucketed table that are live at `now`."""
    return flt_sale_live(log.table(), now).where("reason IS NULL").drop("reason")


def stm_activity_sessions(stream: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """A key's reads grouped in bursts, given out once a burst is over: in append mode a burst leaves the state, and comes out, when the
    watermark has passed its end. A read that comes later than that is dropped. Needs key, checked_at."""
    return (stream.withWatermark("checked_at", late).groupBy(F.session_window("checked_at", gap).alias("s"), "key").agg(F.count("*").alias("reads"))
            .select("key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "reads"))
