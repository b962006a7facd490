import hashlib
import random

from pyspark.sql import functions as F

from offerlake.llm import order_minhash as M


def test_report_of_edits(spark):
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.randint(20, 200))) for _ in range(40)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, "x"), (203, "same text again é"), (210, "same text again é"), (211, "漢字仮名交じり文です" * 3), (212, "dup dup dup dup " * 500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("edited", F.lit(1)).repartition(5)
    got = {r.doc_id: r for r in M.edit_report(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) or edited != t
    assert got[203].fingerprint == got[210].fingerprint
    assert got[200].near_next == 1.0 and got[201].near_next == 0.0
    long_ones = [got[i] for i, t in rows[:40] if len(t) > 300]
    assert sum(r.near_edited > r.near_next for r in long_ones) >= 0.9 * len(long_ones)


def test_order_counts_and_repeats_are_numbered(spark):
    words = [f"w{i}" for i in range(400)]
    forward, swapped = " ".join(words), " ".join(words[200:] + words[:200])
    df = spark.createDataFrame([(forward, swapped, " ".join(words[:-1]), "a b c " * 50, "a b c " * 60)], "a string, b string, c string, d string, e string")
    r = df.select(*[M.order_minhash(F.col(c)).alias(c) for c in "abcde"]).select(
        M.likeness(F.col("a"), F.col("a")).alias("self"), M.likeness(F.col("a"), F.col("b")).alias("swapped"), M.likeness(F.col("a"), F.col("c")).alias("cut"), M.likeness(F.col("d"), F.col("e")).alias("longer")).first()
    assert r.self == 1.0 and r.cut > 0.9
    assert r.swapped < 0.75       # nearly the same k-mers, but half of the pairs are in another order
    assert r.longer < 1.0


def test_elements_against_a_slow_version(spark):
    text = "the cat sat on the cat sat on the mat and the cat sat"
    w = text.split()
    h = spark.createDataFrame([(i, *w[i:i + 3]) for i in range(len(w) - 2)], "i int, a string, b string, c string").select(
        "i", F.shiftrightunsigned(F.xxhash64("a", "b", "c"), 32).alias("h")).orderBy("i").collect()
    seen, items = {}, []
    for r in h:
        items.append((r.i, r.h, seen.setdefault(r.h, 0)))
        seen[r.h] += 1
    df = spark.createDataFrame(items, "i int, h bigint, occ int").select("i", F.shiftrightunsigned(F.xxhash64("h", "occ"), 32).alias("g")).collect()
    slots = {}
    for r in df:
        slots.setdefault(r.g % 16, []).append((r.g >> 4, r.i))
    got = spark.createDataFrame([(text,)], "t string").select(M.order_minhash(F.col("t"), 3, 16, 2).alias("f")).first().f
    tuples = spark.createDataFrame([(s, [(s << 28) | g for g, i in sorted(sorted(v)[:2], key=lambda x: x[1])]) for s, v in slots.items()], "slot int, hs array<bigint>").select(
        "slot", F.reduce("hs", F.lit(42).cast("bigint"), lambda a, x: F.xxhash64(a, x)).alias("e")).collect()
    want = {r.slot: f"{r.e % 2**64:016x}"[8:] for r in tuples}
    assert [got[8 * i:8 * i + 8] for i in range(16)] == [want.get(i, "." * 8) for i in range(16)]


def test_small_tables(spark):
    one = spark.createDataFrame([(5, "abcd")], "doc_id bigint, text string")
    r = M.edit_report(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert M.edit_report(one.limit(0)).collect() == []
    ties = spark.createDataFrame([(None, "n"), (1, "a"), (1, "b"), (1, "a")], "doc_id bigint, text string")
    assert M.edit_report(ties).count() == 4
