"""Wordings with the values they must give."""

from pyspark.sql import functions as F

from offerlake.functions import sc_sale_rank
from offerlake.operators.sales import job_sale_dates, job_sale_offer
from offerlake.operators.terms import job_ad_terms
from offerlake.operators.wordwork import bogo_of

ITEM = {"name": "Bolt", "pre_price_text": None, "price_text": None, "sale_story": None, "description": None, "disclaimer_text": None, "price": None, "original_price": None, "dollars_off": None,
        "percent_off": None, "in_store_only": False, "membership": "", "feed": False}
SCHEMA = ("name string, pre_price_text string, price_text string, sale_story string, description string, disclaimer_text string, price double, original_price double, dollars_off double, percent_off double, "
          "in_store_only boolean, membership string, feed boolean")


def terms(spark, **fields):
    return job_ad_terms(spark.createDataFrame([tuple({**ITEM, **fields}.values())], SCHEMA)).first()["terms"]


def test_saving_from_the_stores_feed(spark):
    t = terms(spark, price=999.99, dollars_off=200.0, feed=True)
    assert (t["regular"], t["pct"], t["basis"]) == (1199.99, 16.7, "store_regular")


def test_saving_not_from_the_feed(spark):
    t = terms(spark, price=24.99, dollars_off=76.0)
    assert (t["basis"], t["savings"]) == ("claimed_savings", 76.0)


def test_multi_buy(spark):
    t = terms(spark, price=8.0, pre_price_text="2/", original_price=10.98, feed=True)
    assert (t["qty"], t["bundle_price"], t["price"]) == (2, 8.0, 4.0)


def test_whole_case_is_no_regular_price(spark):
    t = terms(spark, price=4.62, price_text="per lb", original_price=184.95)
    assert t["basis"] == "none" and t["pct"] is None


def test_bogo(spark):
    rows = spark.createDataFrame([("Buy 1 get 1 half off",), ("Buy 2 get 1 free",), ("buy 1 get 1 for $1",), ("Buy 1 get 150% OFF",), ("BOGO",)], "t string").select(bogo_of(F.col("t")).alias("b")).collect()
    assert [r["b"]["pct"] for r in rows] == [25.0, 33.3, None, 25.0, 50.0]


def test_sale_rank(spark):
    rows = [(40.0, None, None, None, None), (None, 80.0, None, None, None), (None, 60.0, 25.0, None, None), (60.0, None, 25.0, None, None), (None, None, None, 15.0, 50.0), (None, None, None, 1600.0, None)]
    df = spark.createDataFrame(rows, "pct double, upto double, extra double, off double, min_spend double")
    none = F.lit(None).cast("double")
    got = [r[0] for r in df.select(sc_sale_rank(F.col("pct"), F.col("upto"), F.col("extra"), none, F.col("off"), F.lit(False), F.col("min_spend"), none)).collect()]
    assert got == [40.0, 40.0, 47.5, 70.0, 15.0, None]


def test_sale_offers(spark):
    titles = ["Kohl's Deal Days Sale: Up to 60% off + Extra 25% off", "Sale: 30% to 50% off", "Buy 3, get 20% off toys", "Up to $150 in instant credits on TVs", "Shoes (Up to 64% off)"]
    got = [(r["pct"], r["upto"], r["extra"], r["off"], r["buy_n"]) for r in job_sale_offer(spark.createDataFrame([(t,) for t in titles], "title string")).collect()]
    assert got == [(None, 60.0, 25.0, None, None), (30.0, 50.0, None, None, None), (20.0, None, None, None, 3), (None, None, None, 150.0, None), (None, 64.0, None, None, None)]


def test_sale_dates(spark):
    posts = [("A sale", "Through October 8th at Kohl's. Earn cash, redeemable October 9-19."), ("Sale 10/3-10/6", "x"), ("A sale", "Monday through Friday hours."), ("A sale", "ends Monday!")]
    df = spark.createDataFrame(posts, "title string, text string").withColumns({"posted_at": F.lit("2026-10-02 15:00:00").cast("timestamp"), "source": F.lit("x"), "expires_at": F.lit(None).cast("timestamp"), "expires_stated": F.lit(False)})
    got = [r[0] for r in job_sale_dates(df, F.lit("2026-10-02 15:00:00").cast("timestamp")).select(F.date_format(F.from_utc_timestamp("ends_at", "America/Chicago"), "MM-dd")).collect()]
    assert got == ["10-08", "10-06", None, "10-05"]
