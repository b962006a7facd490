"""Queries of the streams: the events table read as a stream, run to its end, and read back from the sink's files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_path
from ..streaming import streams as st
from ..streaming.buckets import BucketLog
from .catalog import query
from .inputs import Tables, using


PARTS = 3


def event_stream(t: Tables, closed: bool = False) -> DataFrame:
    """The events as they arrive, with the columns of `Tables.posts` that the streams use: dealt in order of time to three lots of files that are
    taken up a lot a trigger. `closed` adds a last row without a seller, long after the others, which moves the watermark past them."""
    events = t.read("events").select(F.col("event_id").alias("event"), F.col("user_id").alias("seller"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
                                     F.get_json_object("props", "$.k").cast("int").alias("k"))
    span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.min(F.unix_micros("ts")).alias("from"), F.max(F.unix_micros("ts")).alias("to")).first()
    lot = F.least(F.floor((F.unix_micros("ts") - F.lit(span["from"])) * PARTS / F.lit(max(1, span["to"] - span["from"]))), F.lit(PARTS - 1))
    at, files = work_path(t.spark, "events"), events.rdd.getNumPartitions()
    for i in range(PARTS):
        events.where(lot == i).repartition(files).write.mode("append").parquet(at)
    if closed:
        nobody = t.spark.range(1).select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in events.schema])
        nobody.withColumn("ts", F.lit(span.hi) + F.make_dt_interval(F.lit(100))).write.mode("append").parquet(at)
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(at)


def run(t: Tables, writer, name: str) -> None:
    q = writer.option("checkpointLocation", work_path(t.spark, f"{name}-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()


def appended(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    out = work_path(t.spark, name)
    run(t, stream.writeStream.outputMode("append").format("parquet").option("path", out), name)
    return t.spark.read.schema(stream.schema).parquet(out)


def updated(t: Tables, stream: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Every batch's updates, with the batch's number."""
    out = work_path(t.spark, name)

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/written={n}")
    run(t, stream.writeStream.outputMode(mode).foreachBatch(write), name)
    return t.spark.read.parquet(out)


@query("stm_post_dedupe", using("posts", body="SELECT DISTINCT seller, k FROM posts"))
def _(t: Tables):
    s = event_stream(t).select(F.concat_ws("-", "seller", "k").alias("id"), F.col("ts").alias("posted_at"), "seller", "k")
    return appended(t, st.stm_post_dedupe(s, "60 days"), "dedupe").select("seller", "k")


@query("stm_price_windows", """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, user_id AS product, min(value) AS lowest, floor(avg(value) * 1000 + 0.5) / 1000 AS average, count(*) AS n FROM events GROUP BY ALL""")
def _(t: Tables):
    from ..functions.amounts import rounded
    s = event_stream(t).select(F.col("seller").alias("product"), "price", F.col("ts").alias("observed_at"))
    u = updated(t, st.stm_price_windows(s), "prices")
    last = u.groupBy("start", "product").agg(F.max(F.struct("batch", "lowest", "average", "n")).alias("b"))
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "product", "b.lowest", rounded(F.col("b.average"), 3).alias("average"), "b.n")


@query("stm_read_log", using("posts", body="""
    WITH r AS (SELECT seller AS key, posted_at AS seen, k % 2 = 0 AS found, row_number() OVER (PARTITION BY seller ORDER BY posted_at, k % 2 = 0) AS i FROM posts),
    walk AS (SELECT key, i, seen, found, true AS kept FROM r WHERE i = 1
      UNION ALL SELECT w.key, r.i, CASE WHEN w.found = r.found AND epoch_us(r.seen) - epoch_us(w.seen) < 3600000000 THEN w.seen ELSE r.seen END, r.found,
                       NOT (w.found = r.found AND epoch_us(r.seen) - epoch_us(w.seen) < 3600000000) FROM walk w JOIN r ON r.key = w.key AND r.i = w.i + 1)
    SELECT key, count(*) AS kept, count(*) FILTER (WHERE found) AS found FROM walk WHERE kept GROUP BY key"""))
def _(t: Tables):
    s = event_stream(t).select(F.col("seller").alias("key"), F.col("ts").alias("checked_at"), (F.col("k") % 2 == 0).alias("found"))
    out = work_path(t.spark, "reads")
    run(t, st.stm_read_log(s, out), "reads")
    return t.spark.read.schema("key bigint, checked_at timestamp, found boolean").parquet(f"{out}/kept").groupBy("key").agg(F.count("*").alias("kept"), F.count_if("found").alias("found"))


@query("stm_label_upsert", using("posts", body="""
    SELECT seller AS key, arg_max(source, posted_at) AS source FROM posts GROUP BY seller HAVING max(posted_at) >= TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 2 DAY"""))
def _(t: Tables):
    out = work_path(t.spark, "labels")
    none = F.array().cast("array<string>")
    s = event_stream(t).select(F.col("seller").alias("key"), F.col("ts").alias("seen_at"), "source", none.alias("words"), none.alias("categories"))
    now = F.lit("2024-01-31 12:00:00").cast("timestamp")
    run(t, st.stm_label_upsert(s, out, now, 2), "labels")
    return st.label_table(BucketLog(t.spark, out, s.schema, ["key"]), now, 2).select("key", "source")


@query("stm_live_set", using("posts", body="""
    SELECT id, source FROM posts WHERE NOT (coalesce(expires_at < TIMESTAMP '2024-01-20 12:00:00', false) OR (expires_at IS NULL AND posted_at < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY))"""))
def _(t: Tables):
    out = work_path(t.spark, "live")
    ends = F.when(F.col("k") % 3 != 0, F.col("ts") + F.make_dt_interval(hours=F.col("k")))
    s = event_stream(t).select(F.col("event").alias("id"), F.col("ts").alias("posted_at"), F.lit(None).cast("timestamp").alias("starts_at"), ends.alias("ends_at"), "source")
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    run(t, st.stm_live_set(s, out, now), "live")
    return st.live_table(BucketLog(t.spark, out, s.schema, ["id"]), now).select("id", "source")


@query("stm_activity_sessions", """
    SELECT key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS reads FROM (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY key, s""")
def _(t: Tables):
    s = event_stream(t, closed=True).select(F.col("seller").alias("key"), F.col("ts").alias("checked_at"))
    over = appended(t, st.stm_activity_sessions(s, "6 hours", "1 day"), "sessions").where("key IS NOT NULL")
    return over.select("key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "reads")
