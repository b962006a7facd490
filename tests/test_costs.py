"""What a row costs: only what is asked for is worked out, a search is left out where a text lacks its sign, tasks share the work."""

import re

import pytest
from pyspark.sql import functions as F

from offerlake.operators import wordwork as w
from offerlake.plans import QUERIES
from offerlake.plans.wording import case
from offerlake.rules import wordings as R


def test_case_works_out_the_picked_value_only(spark):
    never = F.raise_error(F.lit("worked out"))
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    assert [r[0] for r in df.select(case("n", F.lit("a"), "b", never)).collect()] == ["a", "b", None]
    with pytest.raises(Exception, match="worked out"):
        df.select(F.lit(3).alias("n")).select(case("n", F.lit("a"), "b", never)).collect()
    with pytest.raises(Exception, match="no value has this number"):
        spark.createDataFrame([(4,)], "n int").select(case("n", F.lit("a"), "b", F.lit("c"))).collect()


TEXTS = ["Buy 2 get 20% off, up to 30% off, 10% to 20% off, extra 5% off $50", "Spend $100, get $20 gift card, buy 3 save $6, $5 off, 2 for $9, was $9, list price of $20, that's $9 off",
         "ends 10/4, 9/1 - 9/5, free shipping on $35", "buy one get one half off", "", None]


def test_a_sign_stands_in_every_match():
    signs = {"%": "[%]", "$": "[$]", "/": "[/]"}
    for pattern, sign in R.SIGNS.items():
        for text in filter(None, TEXTS):
            without = re.sub(signs[sign], " ", text)
            assert not re.search(pattern, without, re.I), pattern


def test_signs_change_no_result(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    c, patterns = F.col("t"), list(R.SIGNS)

    def read():
        cols = [f(c, p).alias(f"{f.__name__}{n}") for n, p in enumerate(patterns) for f in (w.got, w.says, w.without, w.without_first, w.matches)]
        return df.select("i", *cols).orderBy("i").collect()
    guarded = read()
    monkeypatch.setattr(R, "SIGNS", {})
    assert guarded == read()


def test_schedules_are_read_in_dealt_tasks(spark):
    plan = QUERIES["job_schedule_reading"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [id" in plan


def test_a_large_part_of_a_snapshot_is_written_by_several_tasks(spark, tmp_path):
    from offerlake.sources.sinks import snk_snapshot
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    df = spark.range(0, 40000, 1, 8).selectExpr("id", "0 AS part", "sha2(cast(id AS string), 256) AS text")
    old = spark.conf.get(size)
    spark.conf.set(size, "500k")
    try:
        snk_snapshot(df, f"file://{tmp_path}/s", ["part"])
    finally:
        spark.conf.set(size, old)
    assert len([f for f in (tmp_path / "s" / "part=0").iterdir() if f.name.startswith("part-")]) > 1
    assert spark.read.json(f"file://{tmp_path}/s").select("id").distinct().count() == 40000


def test_words_are_read_only_where_they_decide(spark, monkeypatch):
    from offerlake.operators import classify as cl
    monkeypatch.setattr(cl, "says", lambda t, rx: F.when(t == "never", F.raise_error(F.lit("read")).cast("boolean")).otherwise(F.lit(False)))
    posts = spark.createDataFrame([("a", "dealnews", "never", "Games", [], [], []), ("b", "slickdeals", "x", "never", [], [], [])],
                                  "id string, source string, title string, category string, feeds array<string>, feed_categories array<string>, sells array<string>")
    leaves = spark.createDataFrame([("games", ["toys"])], "leaf string, categories array<string>")
    assert {r.id: (r.categories, r.rule) for r in cl.job_classify_posts(posts, leaves).collect()} == {"a": (["toys"], "dealnews:Games"), "b": ([], "")}
    items = spark.createDataFrame([("i", "never", "", "Media", None, [], [], False, True)], "id string, title string, brand string, l1 string, l2 string, prior array<string>, sells array<string>, exclusive boolean, food boolean")
    taxonomy = spark.createDataFrame([("Media", None, ["tech"])], "l1 string, l2 string, categories array<string>")
    assert [(r.categories, r.rule) for r in cl.job_classify_items(items, taxonomy, overrides=[]).collect()] == [(["tech"], "taxonomy:Media")]
    sales = spark.createDataFrame([("s", "x", "never", "never", "never", False, False, "k", [], ["home"], "feed:f")],
                                  "id string, title string, text string, category string, name string, sitewide boolean, store_event boolean, store string, sells array<string>, categories array<string>, rule string")
    assert [(r.categories, r.rule) for r in cl.job_classify_sales(sales).collect()] == [(["home"], "feed:f")]


def test_what_stands_before_ingredients_decides_else_all_of_it(spark):
    from offerlake.operators import classify as cl
    df = spark.createDataFrame([("Body Wash with Coffee",), ("Thing with Coffee",), ("Thing",), (None,)], "t string")
    assert [r[0].rule for r in df.select(cl.from_text(F.col("t"), cl.K.STARTER_RULES)).collect()] == ["keywords:beauty", "keywords:grocery", "", ""]


def test_a_list_of_sales_is_made_once_for_its_checks(spark):
    from offerlake.operators.quality import dq_sales_list
    ts = lambda s: F.lit(s).cast("timestamp")
    name = F.element_at(F.array(*[F.lit(x) for x in ("red bolt", "red bolt", "red bolt box", "blue nut", "", "green gear")]), (F.col("id") + 1).cast("int"))
    sales = spark.range(6).select(F.col("id").cast("string").alias("id"), F.col("id").alias("pos"), F.lit("k").alias("store"), F.lit("K").alias("store_name"), F.lit("20% off").alias("badge"), name.alias("name"), F.lit("20% off").alias("offer"),
                                  F.when(F.col("id") == 3, ts("1998-05-01")).otherwise(ts("1998-07-01")).alias("ends_at"), ts(None).alias("starts_at"), ts("1998-05-30").alias("posted_at"),
                                  F.when(F.col("id") == 5, 9.0).otherwise(-F.col("id")).cast("double").alias("score"), F.lit("https://x.com/").alias("source_url"), F.array(F.lit("home")).alias("categories"))
    # one day of its own for the ended sale
    checks = dq_sales_list(sales, ts("1998-06-01"))
    assert "Range" not in checks._jdf.queryExecution().optimizedPlan().toString()
    assert {r.check: r.problems for r in checks.collect()} == {"same wording": 1, "similar wording": 1, "fresh": 1, "order": 1, "complete": 1}


def test_a_title_without_a_sale_word_is_asked_for_no_event(spark, monkeypatch):
    from offerlake.operators import sales
    real = sales.is_store_event
    monkeypatch.setattr(sales, "is_store_event", lambda n: F.when(n == "", F.raise_error(F.lit("asked")).cast("boolean")).otherwise(real(n)))
    df = spark.createDataFrame([("big savings",), ("Wilson's Stock Up sale",), (None,), ("Deals of the day",)], "title string")
    name, own = sales.leading_name(F.col("title"))
    assert [tuple(r) for r in df.select(name, own).collect()] == [("", False), ("Wilson", True), ("", False), ("", False)]
