"""List pages of both forms, and what entries ask of the customer."""

import random

from pyspark.sql import functions as F

from offerlake.operators.standing import free_thing, standing_conditions
from offerlake.sources import readers as rd

# sentence, the days it names, and whether it is filler, names another offer, or restricts the offer before it
POOL = [("Get wings for $8 on Tuesdays.", {1}, "", ""), ("Half price pies on Mondays and Tuesdays.", {0, 1}, "", ""), ("Tacos are $2 on Wednesdays.", {2}, "", ""), ("Sonic also has shakes on Tuesdays.", {1}, "other", ""),
        ("It also has a new menu.", set(), "other", ""), ("Dine-in only.", set(), "", "limits"), ("Click here for the whole menu.", set(), "filler", ""), ("The staff is kind.", set(), "", ""),
        ("The whole family can enjoy a long evening there with a good view of the old harbor and the ships in it.", set(), "", ""),
        ("You must mention the deal to your waiter when you order, and you may want to come early since tables go fast.", set(), "", "limits"),
        ("The chain announced the special on its page some days ago, and many a guest was glad to hear of it at last.", set(), "", ""),
        ("Kids eat free daily.", set(range(7)), "", ""), ("Chuck E. Cheese is fun.", set(), "", "")]


def fold(day, paragraphs):
    """The entry of a section, sentence by sentence."""
    kept, lead = [], ""
    for p in paragraphs:
        lead = lead or (p[0][0] if p else "")
        gap = 99
        for text, days, kind, limits in p:
            if kind == "filler":
                continue
            if day in days:
                kept.append(text)
                gap = 99 if kind == "other" else 0
                continue
            gap += 1
            if days or kind == "other":
                gap = 99
            elif (gap == 1 and len(text) <= 70) or (gap <= 3 and limits):
                kept.append(text)
                gap = 0
    return (" ".join(dict.fromkeys(kept))[:700], "" if lead in kept else lead) if kept else None


def test_sections_are_folded_sentence_by_sentence(spark):
    rnd = random.Random(6)
    pages, want = [], []
    for i in range(60):
        html = "<nav>Every Tuesday</nav>"
        for j in range(rnd.randint(1, 4)):
            paragraphs = [[rnd.choice(POOL) for _ in range(rnd.randint(0, 8))] for _ in range(rnd.randint(0, 3))]
            brand = f"Pub &amp; Co {j}"
            html += f"<h2 class='x'>{brand}</h2>" + "".join("<p>" + " ".join(s[0] for s in p) + "</p>" for p in paragraphs)
            got = fold(1, paragraphs)
            if got:
                want.append((f"https://l.com/{i}", 1, f"Pub & Co {j}", *got))
        pages.append((f"https://l.com/{i}", 1, html, "sections"))
    df = spark.createDataFrame(pages, "url string, day int, html string, form string")
    got = [(r.url, r.day, r.brand, r.text, r.context) for r in rd.src_roundup_lists(df).collect()]
    assert sorted(got) == sorted(want)


def test_bulleted_days_and_links(spark):
    html = ('<script>var a = "<h2>No</h2>"</script><h2>Who?</h2><p>Tuesdays.</p><h2>Bar</h2><p>Old news.</p><p>For members:</p><ul><li>Half price pies on Tuesdays</li><li>Free fries on Fridays</li><li>Tuesdays</li></ul>'
            '<a href="https://l.com/x">a</a><a href="https://www.instagram.com/x">b</a><a href="https://bar.com/?a=1&amp;b=2">c</a><h2>' + "x" * 46 + "</h2><p>Wings on Tuesdays.</p><h2>unclosed <p>Wings on Tuesdays.</p>")
    df = spark.createDataFrame([("https://www.l.com/p", 1, html, "sections"), ("u", 1, None, "sections"), ("u", 1, "", "items")], "url string, day int, html string, form string")
    assert [(r.brand, r.text, r.context, r.link, r.section) for r in rd.src_roundup_lists(df).collect()] == [("Bar", "Half price pies on Tuesdays", "For members:", "https://bar.com/?a=1&b=2", "every")]


def test_conditions_of_entries(spark):
    said = [("Rewards members get a free taco with a $5 minimum purchase, limit two.", ["rewards members", "with a $5 purchase", "limit 2"], "taco"),
            ("Order online or in the app with code SAVE20.", ["online or in the app", "code SAVE20"], None), ("Order online, with the app, or in-store at the kiosk.", [], None),
            ("It's $9 at lunch and $12 at dinner; dine-in only.", ["dine-in only", "$9 at lunch, $12 at dinner"], None), ("Kids 12 and under eat free with any adult entrée.", ["with an adult entrée", "kids 12 and under"], "with"),
            ("Seniors 55+ get free coffee and a refill. One free coffee per visit.", ["limit 1", "age 55+"], "coffee"), ("A bar special. Only at the bar.", ["at the bar only", "at the bar"], None),
            ("Sign in to your account. Prime members only.", ["Prime members", "signed in to an account"], None), ("Free shipping for all, 20% off for ages 30+.", [], None)]
    rows = spark.createDataFrame([(i, s[0]) for i, s in enumerate(said)], "id int, t string").select("id", standing_conditions(F.col("t")).alias("c"), free_thing(F.col("t")).alias("f")).orderBy("id").collect()
    for (text, want, free), r in zip(said, rows):
        assert r.c == want, text
        assert r.f == (None if free == "with" else free), text
