import math
import random
import re
from collections import Counter

from offerlake.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(docs, items, k=10):
    """Every item against every document."""
    bags = [(d, Counter(TERM.findall((t or "").translate(SMALL)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        ranked = []
        for d, b in bags:
            m, score = 100 - 75 + (75 * sum(b.values()) * n_docs) // n_terms, 0
            for t in TERM.findall((text or "").translate(SMALL)):
                if t in b:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m))
            if score > 0:
                ranked.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(ranked)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((tuple(r) for r in L.search(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus():
    rnd = random.Random(5)
    word = lambda: rnd.choice(["a", "B", "cé", "Éa", "d1", "e", "f", "ggg", "h", "漢", "x_y", "Z"])
    docs = [(i, " ".join(word() for _ in range(rnd.randint(1, 40)))) for i in range(80)]
    docs += [(100 + i, "ggg, the hot. B") for i in range(60)] + [(200 + i, "B the HOT ggg") for i in range(30)]      # one class in two spellings
    docs += [(300, None), (301, ""), (302, " ,.!\n"), (303, "nothing_in common?"), (None, "ggg the hot b"), (7, "again 7 a b"), (304, "a " * 5000 + "rare")]
    items = [(0, "GGG hot a a"), (1, "b cé 漢 f"), (2, None), (3, "..."), (4, "unseen words"), (5, "rare a"), (5, "rare a"), (6, " ".join(word() for _ in range(200)))]
    return docs, items


def test_equal_to_every_item_against_every_document(spark):
    docs, items = corpus()
    want = slow(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, cells=10) == want         # a block for each item
    assert run(spark, docs, items, k=3) == slow(docs, items, 3)


def test_a_hash_that_says_too_little_is_verified(spark, monkeypatch):
    docs, items = corpus()
    from pyspark.sql import functions as F
    bags = L.bags
    monkeypatch.setattr(L, "bags", lambda *a: bags(*a).withColumn("hash", F.lit(1).cast("bigint")))
    assert run(spark, docs, items) == slow(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = corpus()
    assert run(spark, docs[:0] or [(1, None)], items) == []
    assert run(spark, docs, [(1, None)]) == []
    clash = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id bigint, text string, m int, first int")
    asked = spark.createDataFrame([(1, "a", 5)], "item_id bigint, text string, rank int")
    assert L.search(clash, asked).count() == 1
    assert L.search(clash.limit(0), asked).collect() == [] and L.search(clash, asked.limit(0)).collect() == []
