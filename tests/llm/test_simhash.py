import random
import re

import xxhash
from pyspark.sql import functions as F

from offerlake.llm import simhash as S


def slow_hash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(fps, bits):
    """The least member of each fingerprint's class, by brute force."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a in fps:
        for b in fps:
            if a < b and bin(a ^ b).count("1") <= bits:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in fps}


def test_fingerprints_and_classes(spark):
    rnd = random.Random(1)
    vocabulary = [f"w{i}É" for i in range(300)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    texts += [t + " Tail" for t in texts[:20]] + texts[:10] + [None, "", " \t\x0b\n", "one", "ONE", "a b", "x\u00a0y z w", "word " * 20000]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("x"))).collect()}
    fps = {i: slow_hash(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    root = roots(set(fps.values()), 2)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert {i: r.component_id for i, r in got.items()} == {i: least[root[f]] for i, f in fps.items()}


def test_crowded_keys_lose_no_link(spark):
    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    center = rnd.getrandbits(64)
    for _ in range(150):        # a cloud whose members share blocks
        f = center
        for b in rnd.sample(range(20), rnd.randint(0, 5)):
            f ^= 1 << b
        fps.add(f)
    for _ in range(60):         # a chain
        center ^= 1 << rnd.randrange(64)
        fps.add(center)
    df = spark.createDataFrame([(i, S.signed(f)) for i, f in enumerate(sorted(fps))], "doc_id bigint, fp bigint")
    for bits in (1, 2):
        edges = S.links(df.select("fp"), bits=bits, small=5).collect()
        assert all(bin((e.a ^ e.b) & (2**64 - 1)).count("1") <= bits for e in edges)
        want = roots(fps, bits)
        got = {r.node % 2**64: r.root for r in S.components(S.links(df.select("fp"), bits=bits, small=5)).collect()}
        same = {}
        for f in fps:
            assert same.setdefault(want[f], got.get(f, S.signed(f))) == got.get(f, S.signed(f))
        assert len(same) == len(set(same.values()))


def test_one_of_each_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (2, "other words here now", "z"), (None, "alone in this world", "n"), (None, "alone in this world", "n")],
                                 "doc_id bigint, text string, fp string")
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "a b c d", "y"), (2, "other words here now", "z"), (None, "alone in this world", "n")]
    assert S.one_of_each(docs.limit(0)).collect() == []
    assert S.near_duplicates(docs.limit(0)).collect() == []


def test_near_copies_go_too(spark):
    rnd = random.Random(8)
    words = lambda n: [f"v{rnd.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(25):                     # originals with copies edited here and there
        base = words(rnd.randint(40, 200))
        texts.append(base)
        for _ in range(rnd.randint(0, 4)):
            edited = base[:]
            for _ in range(rnd.randint(0, 6)):
                edited[rnd.randrange(len(edited))] = "edit"
            texts.append(edited)
    crowd = words(300)
    for i in range(60):                     # one large group
        texts.append(crowd[:i * 4] + [f"x{i}"] + crowd[i * 4 + 1:])
    rnd.shuffle(texts)
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or bin(slow_hash(" ".join(texts[a])) ^ slow_hash(" ".join(texts[b]))).count("1") <= 2:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in S.one_of_each(docs).collect()) == sorted({find(i) for i in range(len(texts))})


def test_crowded_bands_lose_no_class(spark):
    """An original with copies that are like it but not like each other, and sources that share a passage: all in one band key."""
    rnd = random.Random(12)
    words = lambda n: [f"v{rnd.randrange(9000)}" for _ in range(n)]

    def edited(t, at):
        t = t[:]
        for i in at:
            t[i] = f"e{rnd.randrange(10**6)}"
        return t
    hub = words(200)
    hub_and_edits = [hub] + [edited(hub, rnd.sample(range(10, 190), 3)) for _ in range(80)]
    chain = [words(120)]
    for i in range(25):                     # each like the one before it only
        chain.append(edited(chain[-1], [5 + (20 * i + k * 7) % 110 for k in range(2)]))
    passage = words(130)
    sources = []
    for _ in range(30):
        one = passage + words(40)
        sources += [one, edited(one, [150])] if rnd.random() < 0.5 else [one]
    for texts, block in ((hub_and_edits, 512), (hub_and_edits[1:] + hub_and_edits[:1] + chain + sources, 10), (sources, 3)):
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
        rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), S.marks_of(F.col("text"), 3, True).alias("m")).select("doc_id", "mark", "m.n", "m.sketch", F.array(F.lit(1).cast("bigint")).alias("bands"))
        mark = {r.doc_id: r.mark for r in rows.collect()}
        sets = {mark[i]: {tuple(t[j:j + 5]) for j in range(len(t) - 4)} for i, t in enumerate(texts)}
        like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        edges = S.near_copies(docs, rows, "text", 0.8, block).collect()
        assert all(like(e.a, e.b) for e in edges)

        def classes(links):
            root = {m: m for m in sets}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x
            for a, b in links:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
            return {m: find(m) for m in sets}
        assert classes((e.a, e.b) for e in edges) == classes((a, b) for a in sets for b in sets if a < b and like(a, b))
