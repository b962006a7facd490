import html
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from offerlake.functions.entities import fn_unescape
from offerlake.operators.merging import dd_regular_merge
from offerlake.operators.aggregates import agg_merchant_table
from offerlake.operators.quality import page_offer
from offerlake.operators.textjoins import jn_dictionary_scan
from offerlake.sources import readers as rd
from offerlake.sources import sinks as sk


def test_references_are_decoded_as_html_says(spark):
    texts = ["Kid&#39;s meal &amp; drink&nbsp;half price", "&lt;b&gt; &eacute; &notit; &copy2024", "&#x41;&#0;&#150;&#x1F600;&#xD800;", "a & b &unknown; &amp;amp; &amp", "", "&&amp;&", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(fn_unescape(F.col("t")).alias("u")).collect()
    assert [r.u for r in got] == [t if t is None else html.unescape(t) for t in texts]


def test_pages_show_what_a_visitor_sees(spark):
    page = spark.createDataFrame([("<p>Kid&#39;s meal &amp; drink&nbsp;half price &ndash; daily</p><script>x={\"a\":\"Half\\u0020price tacos on Tuesdays, all day, at every place we run in the state\"}</script>",)], "html string")
    r = rd.src_html_pages(page).first()
    assert r.visible.replace(" ", " ") == "Kid's meal & drink half price - daily"
    assert r.in_scripts == "Half price tacos on Tuesdays, all day, at every place we run in the state"


def test_the_later_example_of_a_batch_wins(spark):
    day = lambda d: datetime(2024, 1, d)
    none = spark.createDataFrame([], "key string, source string, words array<string>, categories array<string>, seen_at timestamp")
    new = spark.createDataFrame([("k", "z", ["old"], [], day(1)), ("k", "b", ["new"], [], day(5))], none.schema)
    after, added = sk.snk_label_upsert(none, new, F.lit(day(10)), 60)
    assert [(r.source, r.words) for r in after.collect()] == [("b", ["new"])] and added.first()[0] == 1


def slow_log(stored, new, gap):
    out = []
    for key in {k for k, *_ in new}:
        last = max(((t, f) for k, t, f, _ in stored if k == key), default=None)
        for _, t, f, q in sorted(x for x in new if x[0] == key):
            if last and (t - last[0]).total_seconds() < gap and last[1] == f:
                continue
            last = (t, f)
            out.append((key, t, f, q))
    return sorted(out)


def test_a_day_of_half_hourly_reads_keeps_one_an_hour(spark):
    start, rnd = datetime(2024, 1, 1), random.Random(3)
    schema = "key bigint, checked_at timestamp, found boolean, quote string"
    half = [(1, start + timedelta(minutes=30 * i), True, f"q{i}") for i in range(48)]
    none = spark.createDataFrame([], schema)
    assert sk.snk_read_log(none, spark.createDataFrame(half, schema)).count() == 24
    stored = [(k, start + timedelta(minutes=rnd.randrange(300)), rnd.random() < 0.5, "s") for k in range(5)]
    new = list({(k, m): (k, start + timedelta(minutes=300 + m), rnd.random() < 0.8, f"{k}/{m}") for k, m in ((rnd.randrange(6), rnd.randrange(2000)) for _ in range(300))}.values())
    got = sk.snk_read_log(spark.createDataFrame(stored, schema), spark.createDataFrame(new, schema)).collect()
    assert sorted(map(tuple, got)) == slow_log(stored, new, 3600)


def test_a_key_with_most_reads_is_many_groups(spark):
    """A minute apart for weeks, and one key has nearly all reads: paths of kept reads are long, groups are not."""
    n = 100_000
    reads = spark.range(n).select(F.lit(7).cast("bigint").alias("key"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("checked_at"), F.lit(True).alias("found"), F.lit("q").alias("quote"))
    others = spark.range(500).select((F.col("id") % 50).alias("key"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 977).alias("checked_at"), (F.col("id") % 7 > 0).alias("found"), F.lit("q").alias("quote")).where("key <> 7")
    none = reads.limit(0)
    got = sk.snk_read_log(none, reads.unionByName(others)).collect()
    times = sorted(r.checked_at for r in got if r.key == 7)
    assert len(times) == -(-n // 60) and {(b - a).total_seconds() for a, b in zip(times, times[1:])} == {3600.0}
    other = sorted(tuple(r) for r in got if r.key != 7)
    assert other == slow_log([], [tuple(r) for r in others.collect()], 3600)


def test_reads_that_come_late_are_compared_with_the_last_stored_one(spark):
    at = datetime(2024, 1, 1, 12)
    schema = "key bigint, checked_at timestamp, found boolean"
    minutes = lambda m: at + timedelta(minutes=m)
    stored = spark.createDataFrame([(1, at, True)], schema)
    new = [(1, minutes(-30), True), (1, minutes(-60), True), (1, minutes(-5), False), (1, at, True), (1, at, False), (1, minutes(59), True), (1, minutes(60), True), (2, at, None)]
    got = {tuple(r) for r in sk.snk_read_log(stored, spark.createDataFrame(new, schema)).collect()}
    assert got == {(1, minutes(-60), True), (1, minutes(-5), False), (1, minutes(60), True), (2, at, None)}


def test_a_product_anywhere_in_a_page_has_its_price(spark):
    ld = lambda body: f'<script type="application/ld+json">{body}</script>'
    pages = [ld('{"@graph":[{"@type":"Person"},{"@type":["Thing","Product"],"offers":[{"price":"12.50"}]}]}'), ld('[{"@type":"Org"},{"a":{"b":[{"@type":"Product","offers":{"lowPrice":7}}]}}]'),
             ld('{"@type":"Article","offers":{"price":"3"}}'), ld("not json {") + ld('{"@type":"Product","offers":{"price":"4.00"}}'), "", None]
    got = spark.createDataFrame([(p,) for p in pages], "html string").select(page_offer(F.col("html")).alias("p")).collect()
    assert [r.p for r in got] == [12.5, 7.0, None, 4.0, None, None]


def test_long_names_are_found(spark):
    texts = spark.createDataFrame([(1, "Head to The Very Best Little Corner Shop Around now")], "id int, text string")
    names = spark.createDataFrame([("s", "The Very Best Little Corner Shop Around", False, False)], "entry string, name string, event boolean, brand boolean")
    assert [(r.entry, r["at"]) for r in jn_dictionary_scan(texts, names).collect()] == [("s", 2)]


def test_covered_merchants_are_far_not_unmapped(spark):
    ads = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "area int, merchant string")
    near = spark.createDataFrame([(1, "a", 3.0)], "area int, chain string, distance_mi double")
    mapped = spark.createDataFrame([("b",)], "merchant string")
    assert {r.merchant: r.status for r in agg_merchant_table(ads, near, 5.0, mapped).collect()} == {"a": "nearby", "b": "far", "c": "unmapped"}


def test_an_offer_with_hours_is_no_everyday_offer(spark):
    row = lambda i, hours: (i, "c1", "list", "l1", "Acme", f"Lunch plate {i} for $9.99", [0, 1, 2, 3, 4], 9.99, None, None, "", "", None, "", hours)
    schema = ("id string, chain string, origin string, source string, brand string, offer string, days array<int>, price double, pct double, regular double, bogo string, summary string, until date, url string, "
              "hours array<struct<a:int,b:int>>")
    kept, reasons = dd_regular_merge(spark.createDataFrame([row("x", [(50400, 61200)])], schema))
    assert [r.id for r in kept.collect()] == ["x"] and reasons.count() == 0
    kept, reasons = dd_regular_merge(spark.createDataFrame([row("y", None)], schema))
    assert kept.count() == 0 and reasons.first().reason.endswith("not tied to a day or time")


def test_a_snapshot_has_as_many_files_as_asked(spark, tmp_path):
    df = spark.range(400).selectExpr("id", "id % 3 AS part").repartition(8)
    sk.snk_snapshot(df, f"file://{tmp_path}/s", ["part"])
    assert all(len([f for f in d.iterdir() if f.name.startswith("part-")]) == 1 for d in (tmp_path / "s").iterdir() if d.is_dir())


def test_lists_are_as_old_as_their_page_says(spark):
    from offerlake.operators.textjoins import jn_asof_last_good_read
    specs = spark.createDataFrame([(1, "list"), (2, "list"), (3, "list"), (4, "article"), (5, "official"), (6, "list"), (7, "list")], "key int, kind string")
    at = datetime(2024, 6, 10)
    reads = spark.createDataFrame([(1, at, True, datetime(2024, 6, 1).date()), (2, at, True, datetime(2024, 1, 1).date()), (3, at, True, None), (4, at, None, None), (5, at, True, None), (6, at, False, None),
                                   (7, at - timedelta(days=1), True, datetime(2024, 6, 1).date()), (7, at, True, None)], "key int, checked_at timestamp, found boolean, page_date date")
    got = {r.key: (r.status, r.live) for r in jn_asof_last_good_read(specs, reads, F.lit(datetime(2024, 6, 11))).collect()}
    assert got == {1: ("confirmed", True), 2: ("too old", False), 3: ("the page carries no date", False), 4: ("unreadable", False), 5: ("confirmed", True), 6: ("the page no longer says this", False),
                   7: ("confirmed", True)}


def test_atom_entries_are_posts_too(spark, tmp_path):
    (tmp_path / "a.xml").write_text('''<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>site</title><entry><title>Bolts &amp;amp; nuts $5.00 at Acme</title><link rel="self" href="https://x.com/self"/>
      <link href="https://x.com/p/1"/><id>g1</id><published>2024-05-01T10:00:00Z</published><summary>Nice &amp;lt;b&amp;gt; ones</summary><category term="Tools"/></entry></feed>''')
    (tmp_path / "b.xml").write_text('''<?xml version="1.0"?><rss><channel><item><title>Nuts $6.00 at Acme</title><link>https://x.com/p/2</link><pubDate>Wed, 1 May 2024 11:00:00 +0000</pubDate><guid>g2</guid><description>x</description></item></channel></rss>''')
    got = {r.url: r for r in rd.src_feed_posts(spark, f"file://{tmp_path}", "bensbargains").collect()}
    assert set(got) == {"https://x.com/p/1", "https://x.com/p/2"}
    r = got["https://x.com/p/1"]
    assert (r.title, r.price, r.seller, r.category, str(r.posted_at)[:16]) == ("Bolts & nuts $5.00 at Acme", 5.0, "Acme", "Tools", "2024-05-01 10:00")
