import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from offerlake.llm import linking, ngram_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=3):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def slow(rows, p=90, q=100, size=3):
    """Every text against every other, and classes by following the links."""
    sets = [(d, shingles(t, size)) for d, t in rows]
    at = list(range(len(sets)))
    def root(i):  # noqa: E306
        while at[i] != i:
            i = at[i]
        return i
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and q * len(a & b) >= p * len(a | b):
                at[root(i)] = root(j)
    least = {}
    for i, (d, a) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(a), least.get(root(i)) if a else d) for i, (d, a) in enumerate(sets)), key=str)


def run(spark, rows, **more):
    return sorted((tuple(r) for r in J.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), **more).collect()), key=str)


def edited(rnd, words, edits):
    words = list(words) or ["x"]
    for _ in range(edits):
        i, kind = rnd.randrange(len(words) or 1), rnd.randrange(3)
        words[i:i + (kind != 0)] = [f"e{rnd.randrange(10 ** 6)}"] if kind != 2 else []
    return " ".join(words)


def families(rnd, n, size, copies, edits, common):
    rows = []
    for _ in range(n):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(*size))] + (common if rnd.random() < 0.5 else [])
        rows += [edited(rnd, base, rnd.randint(*edits)) for _ in range(rnd.randint(*copies))]
    return rows


def test_equal_to_all_pairs(spark):
    rnd = random.Random(2)
    common = [f"c{i}" for i in range(30)]
    texts = families(rnd, 40, (1, 160), (1, 6), (0, 5), common) + families(rnd, 12, (1, 14), (2, 5), (0, 1), [])
    texts += [None, "", " \n\t", "A b C", "a B c", "one", "ONE", "two words", "Two  Words ", "éa É", "ÉA É", "w " * 40, "w " * 400, "\x0b\x0cx\x1cy z q"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, "the same id again"), (None, texts[5]), (None, "no id, no partner")]
    assert run(spark, rows) == slow(rows)


@pytest.mark.parametrize("p,q,size", [(80, 100, 5), (95, 100, 1), (1, 2, 2)])
def test_other_thresholds(spark, p, q, size):
    rnd = random.Random(p)
    rows = list(enumerate(families(rnd, 15, (1, 90), (1, 5), (0, 6), [])))
    assert run(spark, rows, p=p, q=q, size=size) == slow(rows, p, q, size)


def test_a_large_group_of_edited_copies(spark, monkeypatch):
    """Copies edited once to five times: some are linked with the original only, some with nothing; keys are settled in blocks."""
    rnd = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    rows = list(enumerate([edited(rnd, base, rnd.randint(1, 5)) for _ in range(160)])) + [(1000, " ".join(base))]
    across, made = linking.across, []
    monkeypatch.setattr(linking, "across", lambda open_, nodes, p, q, block: made.append(1) or across(open_, nodes, p, q, 10, 64))
    assert run(spark, rows) == slow(rows)
    assert made


def test_chains_of_classes_are_found_across_blocks():
    rnd = np.random.default_rng(1)
    sets = {i: np.unique(rnd.integers(0, 1 << 63, 60, dtype=np.uint64)) for i in range(30)}
    for i in range(30, 60):
        sets[i] = np.unique(np.concatenate([sets[i - 30][3:], rnd.integers(0, 1 << 63, 2, dtype=np.uint64)]))
    rows = pd.DataFrame([(1, i, i, len(h), linking.sketch(h), i % 3, min(i % 3, o), max(i % 3, o)) for i, h in sets.items() for o in range(3)], columns=["key", "node", "root", "n", "sketch", "mine", "lo", "hi"])
    rows["n"] = rows["n"].astype("int64")
    got = {tuple(x) for x in linking.close_pairs(rows, 90, 100, 7).itertuples(index=False)}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))}
    assert len(want) == 30 and want <= got and len(got) < 60


def test_sketches_never_rule_a_link_out():
    rnd = np.random.default_rng(3)
    for n in (5, 200, 60_000):
        x = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64)) * np.uint64(2)
        y = np.concatenate([x[n // 20:], rnd.integers(0, 1 << 63, n // 30, dtype=np.uint64)])
        a, b = (np.frombuffer(linking.sketch(h), dtype=np.uint8) for h in (x, y))
        assert linking.differences(a, b) <= len(np.setxor1d(x, y))


def test_empty_segments_lose_no_pair():
    rnd = np.random.default_rng(5)
    for p, q in ((90, 100), (80, 100)):
        for n in (*range(9, 40), 100, 500):
            for _ in range(20):
                a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
                out = (len(a) * (q - p)) // q
                b = a[np.sort(rnd.permutation(len(a))[:len(a) - out])]
                assert q * len(b) < p * len(a) or out == 0 or set(J.segment_keys(a, p, q)) & set(J.segment_keys(b, p, q))


def test_sets_that_meet_in_a_node_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 7, 1), (2, 7, 1), (3, 7, 2), (4, 8, 5)], "doc_id int, node bigint, check bigint")
    got = {r.doc_id: r.node for r in J.told_apart(rows).collect()}
    assert got[1] == got[2] == 7 and got[3] not in (7, 8) and got[4] == 8


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", 1, 2), (2, "A B c d", 3, 4)], "doc_id bigint, text string, node int, mark int")
    assert sorted(map(tuple, J.similar_documents(docs).collect())) == [(1, 2, 1), (2, 2, 1)]
    assert J.similar_documents(docs.limit(0)).collect() == []
    assert J.similar_documents(docs.withColumn("text", F.lit(None).cast("string"))).count() == 2
