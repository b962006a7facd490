"""What every match of a pattern holds, and texts that are worked out once."""

import random
import re

from pyspark.sql import functions as F

from offerlake.operators import sales
from offerlake.operators import wordwork as w
from offerlake.operators.filters import flt_not_sale
from offerlake.rules import categories as K
from offerlake.rules import standing as S
from offerlake.rules import wordings as R
from offerlake.rules.signs import words_in


def patterns():
    out = {}
    for module in (R, K, S):
        for name, value in vars(module).items():
            if name.isupper() and isinstance(value, str):
                out[value] = name
            elif name.isupper() and isinstance(value, list):
                out.update({x: name for row in value if isinstance(row, tuple) for x in row if isinstance(x, str) and "\\b" in x})
    return out


def test_every_match_holds_a_word_read_from_the_pattern():
    rnd, matched = random.Random(5), set()
    parts = [x for p in patterns() for x in re.sub(r"\\[a-zA-Z]|\(\?[:!<=i]*|[\\()|?*+^]", " ", p).split()] + ["10", "20%", "$5", "6/7", "-", "Oct 4", "to", "off", "free", "B1", "G1", "$35+", "Ends", "through", "Friday", "only", "s&h"]
    texts = [rnd.choice([" ", " ", ", "]).join(rnd.choice(parts) for _ in range(9)) for _ in range(4000)]
    texts = texts + [t.upper() for t in texts[:500]]
    for p, name in patterns().items():
        words = R.WORDS.get(p) or R.MORE_WORDS.get(p) or words_in(p)
        try:
            found = re.compile(p, re.I)
        except re.error:                                 # a look behind of no fixed width
            continue
        if words:
            for t in texts:
                if found.search(t):
                    matched.add(name)
                    assert any(x in t.lower() for x in words), (name, t)
    assert len(matched) > 45


def test_words_of_a_pattern():
    assert words_in(r"\bcoupons?\b") == ("coupon",)
    assert words_in("(?:shipping|shipped|s&h)") == ("&h", "hipped", "hipping")
    assert words_in(r"\d+") is None and words_in("a|b|c") is None and words_in(r"x*") is None
    assert words_in(r"\Qa.b\E") is None                   # written for another engine: not read


def test_alternatives_by_letter_match_as_in_a_row():
    rnd = random.Random(3)
    alternatives = r"price|in|price-in-bag|semi|semi-annual|with|w|st|stars?|\d+(?:-day|-hour)?|promo(?:tion)?s?|it's|its"
    plain, gathered = re.compile(rf"\b(?:{alternatives})\b", re.I), re.compile(r"\b(?:" + R.by_letter(alternatives) + r")\b", re.I)
    parts = "price in bag semi annual with w st star stars 3 24-hour day promos promotion it's its x".split()
    for _ in range(3000):
        t = rnd.choice([" ", "-", ""]).join(rnd.choice(parts) for _ in range(6))
        assert [m.span() for m in plain.finditer(t)] == [m.span() for m in gathered.finditer(t)]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_title_is_cleaned_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "2000")
    posts = spark.createDataFrame([("Toys: 20% off", "text", "sale", None)], "title string, text string, deal_type string, posted_at timestamp")
    read = sales.job_sale_offer(posts)
    assert optimized(read).count("translate(") == 1
    assert optimized(flt_not_sale(read)).count("translate(") == 2
    named = sales.job_sale_name(posts.withColumn("store_names", F.array(F.lit("Acme"))))
    assert optimized(named).count("translate(") <= 3     # the title, the store's spellings, the name found
    coded = sales.job_sale_code_shipping_conditions(read, F.current_date())
    assert optimized(coded).count("translate(") <= 5


def test_says_and_takes_out_the_same_with_and_without_words(spark, monkeypatch):
    texts = ["Ends Oct 5", "10/4 - 10/6", "through friday", "code SAVE10", "FREE shipping w/ $35", "free s&h with Prime", "+ $5 shipping", "select items", "", None, "Clearance: up to 40% off (select)", "BUY one get one half off", "K sale \u212a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    wanted = [p for p in patterns() if "(?<!" not in p]

    def read(t):
        cols = [f(t, p).alias(f"{f.__name__}{n}") for n, p in enumerate(wanted) for f in (w.says, w.without)]
        return df.select("i", w.labels_of(t, R.CONDITIONS).alias("l"), w.first_label(t, R.HEDGES).alias("h"), w.bogo_of(t).alias("b"), *cols).orderBy("i").collect()
    gated = read(F.col("t"))
    assert gated == read(F.concat(F.col("t"), F.lit("")))
    for name in ("SIGNS", "WORDS", "MORE_WORDS"):
        monkeypatch.setattr(R, name, {})
    monkeypatch.setattr(w, "words_in", lambda p: None)
    assert gated == read(F.col("t"))


def test_shipping_words(spark):
    said = {"Toys 20% off + free shipping w/ $35": "Free shipping on $35+", "A: 5% off, free shipping w/ Prime": "Free shipping with Prime", "free s&h with exclusions": "Free shipping, with exclusions", "free shipping w/ select purchase": "Free shipping on some orders",
            "free shipping w/ Plus membership": "Free shipping with Plus membership", "ships free": "Free shipping", "hats + $4.99 shipping": "$4.99 shipping", "hats, shipping varies": "Shipping varies", "hats": "", None: ""}
    df = spark.createDataFrame([(t,) for t in said], "t string")
    assert dict(map(tuple, df.select("t", sales.shipping_words(F.col("t"))).collect())) == said


def test_every_match_about_days_and_times_holds_a_word():
    from offerlake.operators import calendar as C
    rnd, seen = random.Random(2), set()
    parts = ("ruby tuesday's tgi friday's t.g.i. fridays tuesday morning wednesday addams black friday good friday cyber monday easter sunday super bowl sunday ash wednesday fat tuesday giving tuesday sunday ticket monday night football the "
             "13th small business saturday mon-fri Mon to Fri wed thru sat 2 - 5 pm open till close 11 am until 2 pm noon – midnight in January all October during may this August throughout March").split()
    for _ in range(20000):
        i = rnd.randrange(len(parts) - 4)
        t = " ".join(parts[i:i + 4] + [rnd.choice(parts)])
        for p in (C.DAY_RANGE, C.TIME_RANGE, C.NOT_A_DAY, C.IN_MONTH):
            if re.search(p, t, re.I):
                seen.add(p)
                assert any(x in t.lower() for x in R.MORE_WORDS[p]), (p, t)
    assert len(seen) == 4


def test_a_zone_is_searched_once(spark):
    from offerlake.operators.calendar import time_windows
    plan = optimized(spark.createDataFrame([("2-5 pm ET",)], "t string").select(time_windows(F.col("t")).alias("w")))
    assert plan.count(", 9)") + plan.count(", 9,") <= 2
    zones = {"2-5 pm ET": "America/New_York", "after 3 pm (PT)": "America/Los_Angeles", "until 9 pm MST": "America/Denver", "2-5 pm": "", "13-99 pm ET": "America/New_York"}
    df = spark.createDataFrame([(t,) for t in zones], "t string").select("t", time_windows(F.col("t"))["zone"].alias("z"))
    assert {r.t: r.z for r in df.collect() if r.t != "13-99 pm ET"} == {t: z for t, z in zones.items() if t != "13-99 pm ET"}
