import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlake.llm import lang_id as L
from offerlake.llm import quality_gbt as Q

WORDS = {"en": ["the", "of", "and", "thing", "shall"], "de": ["der", "und", "nicht", "sch", "über"], "fr": ["le", "une", "été", "dans", "eaux"], "es": ["los", "ción", "para", "niño", "que"]}


def sentence(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "", rnd.choice(WORDS[lang])]) for _ in range(n))


def test_languages(spark):
    rnd = random.Random(7)
    rows = [(i, sentence(rnd, lang, rnd.randint(3, 60)), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 60)]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 ... !!", "de"), (1003, "the of and thing", None), (1003, "the of and thing", None), (1004, "der und nicht über " * 30000, "fr")]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string").withColumn("score", F.lit("x"))
    usable = F.col("doc_id") % 3 != 0
    got = L.identify(docs, usable & (F.col("doc_id") < 1000)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    held = [by[i].lang_pred == lang for i, _, lang in rows if i % 3 == 0]
    assert sum(held) >= 0.95 * len(held)
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in L.identify(docs, F.lit(False)).collect()} == {"und"}
    assert L.identify(docs.limit(0), F.lit(True)).collect() == []


def test_long_texts_are_read_whole():
    text = "".join(random.Random(8).choice("abc de") for _ in range(5000))
    whole = L.features(text)
    chunk = L.CHUNK
    try:
        L.CHUNK = 700
        pieces = L.features(text)
    finally:
        L.CHUNK = chunk
    assert float(whole @ pieces) > 0.98


def test_trees_against_a_walk_by_hand():
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = Q.grow(x[:400], y[:400], trees=30)
    scores = Q.walk(x, model)
    for i in range(0, 600, 50):
        margin = model["base"]
        for stat, at, leaf in zip(model["stat"], model["at"], model["leaf"]):
            node = 0
            for _ in range(model["depth"]):
                node = 2 * node + 1 + int(x[i, stat[node]] > at[node])
            margin += leaf[node - (2 ** model["depth"] - 1)]
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-margin)))
    assert ((scores[400:] >= 0.5) == y[400:]).mean() > 0.9


def test_quality(spark):
    rnd = random.Random(10)
    rows, labels = [], []
    for i in range(300):
        good = rnd.random() < 0.7
        text = sentence(rnd, "en", rnd.randint(20, 80)) + "." if good else " ".join(w.upper() + "!!" for w in sentence(rnd, "en", 40).split())
        rows.append((i, text))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "x" * 500000), (0, rows[0][1])], "doc_id bigint, text string").withColumn("_label", F.lit(1))
    known = spark.createDataFrame(labels + [(5, None), (None, 1), (7777, 0)], "doc_id bigint, quality int")
    got = Q.score(docs, known, F.col("doc_id") % 3 != 1).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    held = [(by[i] >= 0.5) == bool(q) for i, q in labels if i % 3 == 1]
    assert sum(held) >= 0.95 * len(held)
    assert {r.score for r in Q.score(docs, known.limit(0), F.lit(True)).collect()} == {0.5}
    assert Q.score(docs.limit(0), known, F.lit(True)).collect() == []


@pytest.mark.parametrize("name, column, truth", [("op3_language_families", "lang_pred", "lang"), ("op5_quality_gbt", "predicted", "quality")])
def test_held_out_accuracy_on_the_given_tables(spark, name, column, truth):
    from offerlake.llm import QUERIES
    d = "/root/testdata/sf0.001"
    known = spark.read.parquet(f"{d}/documents.parquet" if truth == "lang" else f"{d}/labels.parquet").select("doc_id", truth)
    got = QUERIES[name](spark, d).join(known, "doc_id").where("held_out").select((F.col(column) == F.col(truth)).cast("int").alias("right")).agg(F.avg("right")).first()[0]
    assert got >= 0.9
