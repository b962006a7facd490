"""Streams over several triggers: rows that come late, a restart between batches, batches that are tried again."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from offerlake.session import work_path
from offerlake.sources import sinks as sk
from offerlake.streaming import streams as st
from offerlake.streaming.buckets import BucketLog

START = datetime(2024, 1, 1)
minute = lambda m: START + timedelta(minutes=m)


class Feed:
    """A folder that files are put into; `run` takes up what is there, one file a trigger, and stops: each run is a restart."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.at, self.state = spark, schema, work_path(spark, "feed"), work_path(spark, "feed-state")

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.at)

    def stream(self):
        return self.spark.readStream.schema(self.spark.createDataFrame([], self.schema).schema).option("maxFilesPerTrigger", 1).parquet(self.at)

    def run(self, writer):
        q = writer.option("checkpointLocation", self.state).trigger(availableNow=True).start()
        q.awaitTermination()
        return q.recentProgress


def test_the_read_log_is_the_same_in_batches_and_as_a_stream(spark):
    rnd = random.Random(4)
    schema = "key bigint, checked_at timestamp, found boolean"
    reads = sorted({(k if rnd.random() < 0.5 else 0, minute(m), rnd.random() < 0.8) for k, m in ((rnd.randrange(5), rnd.randrange(4000)) for _ in range(900))}, key=lambda r: r[1])
    reads = list({(k, t): (k, t, f) for k, t, f in reads}.values())
    feed, out = Feed(spark, schema), work_path(spark, "log")
    for i in range(3):
        feed.put([r for r in reads if i * 1300 <= (r[1] - START).total_seconds() / 60 < (i + 1) * 1300 + (200 if i == 2 else 0)])
        if i != 1:                      # the second file waits for the third: two batches in one run, and a restart before them
            feed.run(st.stm_read_log(feed.stream(), out, buckets=4))
    got = sorted(map(tuple, spark.read.parquet(f"{out}/kept").drop("batch").collect()))
    want = sorted(map(tuple, sk.snk_read_log(spark.createDataFrame([], schema), spark.createDataFrame(reads, schema)).collect()))
    assert got == want
    late = max(r for r in want if r[0] == 0)
    feed.put([(0, late[1] - timedelta(minutes=30), late[2]), (0, late[1] - timedelta(minutes=90), late[2])])
    feed.run(st.stm_read_log(feed.stream(), out, buckets=4))
    assert sorted(map(tuple, spark.read.parquet(f"{out}/kept").drop("batch").collect())) == sorted([*want, (0, late[1] - timedelta(minutes=90), late[2])])


def test_bursts_leave_the_state_when_they_are_over(spark):
    feed, out = Feed(spark, "key bigint, checked_at timestamp"), work_path(spark, "bursts")

    def run():
        progress = feed.run(st.stm_activity_sessions(feed.stream(), "1 hour", "2 hours").writeStream.outputMode("append").format("parquet").option("path", out))
        return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress], sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
    feed.put([(k, minute(10 * i)) for k in range(20) for i in range(3)])
    held, _ = run()
    assert max(held) == 20
    feed.put([(1, minute(600)), (2, minute(45))])              # a late row that still falls into its burst
    run()
    feed.put([(3, minute(30)), (4, minute(2000))])             # one after its burst is over
    held, dropped = run()
    assert dropped == 1 and min(held) < 5
    got = {(r.key, r.start): r.reads for r in spark.read.parquet(out).collect()}
    assert len(got) == 21 and got[2, minute(0)] == 4 and got[3, minute(0)] == 3 and got[1, minute(600)] == 1


def test_a_batch_rewrites_only_its_buckets_and_can_be_tried_again(spark):
    schema = spark.createDataFrame([], "key bigint, v int").schema
    log = BucketLog(spark, work_path(spark, "log"), schema, ["key"], 16)
    put = lambda rows, n, fail=False: log.merge(spark.createDataFrame(rows, schema), n, lambda old, new: sk.latest(old, new, ["key"]))
    put([(k, 0) for k in range(200)], 0)
    whole = log.manifest()
    assert len(whole) == 16
    put([(5, 1)], 1)
    after = log.manifest()
    assert sorted(after.values()) == [0] * 15 + [1]
    put([(5, 1)], 1)                                            # tried again: from the manifest before it
    assert log.manifest() == after and {r.key: r.v for r in log.table().collect()} == {**{k: 0 for k in range(200)}, 5: 1}
    put([], 2)
    assert log.manifest() == after
    put([(5, 3), (6, 3)], 3)
    assert log.versions() == [2, 3] and {r.key: r.v for r in log.table().collect()} == {**{k: 0 for k in range(200)}, 5: 3, 6: 3}
    kept = {(int(b[7:]), int(v[8:])) for v in log._listed(f"{log.path}/data") for b in log._listed(f"{log.path}/data/{v}") if b.startswith("bucket=")}
    assert kept == {*log.manifest(3).items(), *log.manifest().items()}


@pytest.mark.parametrize("restart", [False, True])
def test_examples_and_live_sales_over_several_batches(spark, restart):
    now = F.lit(minute(60 * 24 * 30)).cast("timestamp")
    feed, out = Feed(spark, "key bigint, source string, words array<string>, categories array<string>, seen_at timestamp"), work_path(spark, "labels")
    day = lambda d: minute(60 * 24 * d)
    files = [[(1, "a", [], [], day(1)), (2, "b", [], [], day(25)), (2, "c", [], [], day(24))], [(1, "d", [], [], day(28))], [(3, "e", [], [], day(2)), (2, "late", [], [], day(20))]]
    for f in files:
        feed.put(f)
        if restart:
            feed.run(st.stm_label_upsert(feed.stream(), out, now, 10, 4))
    feed.run(st.stm_label_upsert(feed.stream(), out, now, 10, 4))
    log = BucketLog(spark, out, feed.stream().schema, ["key"], 4)
    assert {r.key: r.source for r in st.label_table(log, now, 10).collect()} == {1: "d", 2: "late"}         # what a poll brings again replaces what was known
    feed, out = Feed(spark, "id bigint, posted_at timestamp, starts_at timestamp, ends_at timestamp, source string"), work_path(spark, "live")
    files = [[(1, day(1), None, day(40), "a"), (2, day(29), None, None, "b"), (3, day(1), None, day(2), "c")], [(1, day(2), None, day(3), "ended after all")], [(3, day(5), None, day(50), "open again")]]
    for f in files:
        feed.put(f)
        if restart:
            feed.run(st.stm_live_set(feed.stream(), out, now, 4))
    feed.run(st.stm_live_set(feed.stream(), out, now, 4))
    log = BucketLog(spark, out, feed.stream().schema, ["id"], 4)
    assert {r.id: r.source for r in st.live_table(log, now).collect()} == {2: "b", 3: "open again"}
