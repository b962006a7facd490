import random

import numpy as np
from pyspark.sql import functions as F

from offerlake.llm import soft_mixing as M


def test_rates_meet_the_targets_and_are_the_nearest(spark):
    rnd = np.random.default_rng(12)
    p = rnd.dirichlet([0.4, 0.3, 0.2], size=300)
    n = rnd.integers(0, 500, size=300)
    members = spark.createDataFrame([(i, int(n[i]), [float(x) for x in p[i]]) for i in range(300)], "doc_id bigint, n_tokens bigint, _p array<double>")
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.02, "b": 0.9, "c": 0.08}, {"a": 1.0}):
        moves, reached = M.fit_rates(members, ["a", "b", "c"], weights, rounds=60)
        rates = np.array([r.rate for r in members.withColumn("rate", M.rate_of(F.col("_p"), moves)).orderBy("doc_id").collect()])
        r = np.ones(300)
        for m in moves:                     # the same rounds by hand
            r = np.maximum(0, r - p @ np.array(m))
        assert np.allclose(r, rates) and (rates >= 0).all()
        target = np.array([weights.get(x, 0.0) for x in "abc"]) * n.sum()
        misfit = np.abs(p.T @ (n * rates) - target).max() / n.sum()
        best = np.ones(300)                 # plain projected gradient, many small steps; targets that cannot be met are come near to
        for _ in range(5000):
            best = np.maximum(0, best - 0.5 * (p @ ((p.T @ (n * best) - target) / n.sum())))
        assert misfit <= np.abs(p.T @ (n * best) - target).max() / n.sum() + (1e-3 if len(weights) > 1 else 0.05)
        assert all(abs(reached["reached"][x] - float((n * rates) @ p[:, i])) < 1e-6 * n.sum() for i, x in enumerate("abc"))


def tables(spark):
    rnd = random.Random(13)
    rows, labels = [], []
    for i in range(400):
        kind = "toxic" if i % 10 == 0 else "poor" if i % 10 < 3 else "sound"
        words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(20, 120))]
        if kind == "toxic":
            words[::9] = [rnd.choice(["idiot,", "moron", "Stupid."]) for _ in words[::9]]
        text = " ".join(w.upper() + "!!" if kind == "poor" else w for w in words)
        rows.append((i, text, "keep"))
        labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    docs = spark.createDataFrame(rows + [(900, None, None), (901, "", None), (0, rows[0][1], "again"), (None, "no id", None)], "doc_id bigint, text string, rate string")
    return docs, spark.createDataFrame(labels + [(3, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")


def test_domains_are_told_apart(spark):
    docs, labels = tables(spark)
    mixed, reached = M.mix(docs, labels)
    got = mixed.collect()
    assert len(got) == 404
    by = {r.doc_id: r for r in got}
    kind = lambda i: "toxic" if i % 10 == 0 else "poor" if i % 10 < 3 else "sound"
    right = [max(("sound", "poor", "toxic"), key=lambda d: by[i][f"p_{d}"]) == kind(i) for i in range(400)]
    assert sum(right) >= 380
    assert all(abs(r.p_sound + r.p_poor + r.p_toxic - 1) < 1e-9 and r.rate >= 0 for r in got)
    for d in ("sound", "poor", "toxic"):
        assert abs(reached["reached"][d] - reached["target"][d]) < 1e-4 * sum(reached["target"].values())
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) - reached["reached"][d]) < 1e-3
    assert abs(reached["target"]["poor"] / reached["target"]["sound"] - 0.07 / 0.9) < 1e-9
    assert all(by[i].copies >= 1 for i in range(400) if kind(i) == "sound" and by[i].p_sound > 0.99)
    same = [r for r in got if r.doc_id == 0]
    assert same[0].rate == same[1].rate and same[0].copies == same[1].copies


def test_without_labels_or_rows(spark):
    docs, labels = tables(spark)
    mixed, _ = M.mix(docs.limit(20), labels.limit(0))
    assert {round(r.p_sound, 6) for r in mixed.collect()} == {round(1 / 3, 6)}
    assert M.mix(docs.limit(0), labels)[0].collect() == []


def test_copies_keep_the_expectation(spark):
    df = spark.range(20000).withColumn("c", M.copies(F.lit(1.3), F.col("id"))).agg(F.avg("c").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).first()
    assert abs(df.m - 1.3) < 0.02 and (df.lo, df.hi) == (1, 2)
