import math
import random
import re

from pyspark.sql import functions as F

from offerlake.llm import divergence_rules as D


def slow_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def jsd(p, q):
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
    return math.sqrt(max(0, sum(part(a, b) + part(b, a) for a, b in zip(p, q)) / 2))


def test_base_counts(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["a", "b", "c", "dé", "#x", "|"]) for _ in range(rnd.randint(0, 80))) for _ in range(60)]
    texts += [None, "", " \n\t", "x\ny\nx\n\nx \n", "one\rtwo\x0bthree\x0cfour five six", "l1\r\nl1\r\n", "a b c a b c a b c " * 300, "🤖🤖 🤖", "q\n" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("lang", F.lit("en")).withColumn("n_words", F.lit("mine"))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in D.judge(docs, refs=[]).collect()}
    assert got == {i: slow_base(t) for i, t in enumerate(texts)}


def test_distances_and_verdicts(spark):
    rnd = random.Random(6)
    common = {"en": ["the", "of", "and", "to"], "de": ["der", "die", "und", "für"]}
    def text(lang, n):  # noqa: E306
        return " ".join(rnd.choice(common[lang]) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)) + "."
    rows = [(i, lang, text(lang, rnd.randint(60, 200))) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(500, None, text("en", 100)), (501, "de", text("en", 100)), (502, "en", text("en", 100).upper()), (503, "en", " ".join(f"{i}#|" for i in range(100))), (504, "en", "short"), (505, "xx", "der " * 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    refs = D.references(docs, min_words=1000)
    assert [r["lang"] for r in refs] == ["de", "en"]
    for r in refs:
        words = [w for i, lang, t in rows if lang == r["lang"] for w in re.split(r"[^a-zü]+", t.lower()) if w]
        share = {w: words.count(w) / len(words) for w in set(words)}
        assert r["words"].keys() == {w for w, s in share.items() if s >= 0.002}
        assert all(abs(s - share[w]) < 1e-12 for w, s in r["words"].items())
    got = {r.doc_id: r for r in D.judge(docs, refs=refs).collect()}
    for i, lang, t in rows[:10] + rows[-6:-2]:
        w = [x for x in re.split(r"[^a-zü]+", t.lower()) if x]
        cs = [len(re.findall(p, t)) for p in ("[a-zü]", "[A-ZÜ]", r"\d", r"\s", r"[.,;:!?'\"()\-]")]
        best = None
        for ref in refs:
            q = list(ref["words"].values())
            p = [w.count(x) / max(1, len(w)) for x in ref["words"]]
            vd = jsd([*p, max(0, 1 - sum(p))], [*q, max(0, 1 - sum(q))]) if len(w) >= 50 else None
            cd = jsd([c / len(t) for c in [*cs, len(t) - sum(cs)]], ref["chars"])
            best = min(x for x in (best, (D.farness(cd, vd, len(w)), cd, vd)) if x)
        assert abs(got[i].char_distance - best[1]) < 1e-6 and (best[2] is None) == (got[i].word_distance is None)
        assert best[2] is None or abs(got[i].word_distance - best[2]) < 1e-6
        assert got[i].kept == (best[0] <= 1)
    assert all(got[i].kept for i in [*range(120), 500, 501])
    assert not any(got[i].kept for i in (502, 503, 504, 505))


def test_empty_and_unreferenced(spark):
    docs = spark.createDataFrame([(1, None, None)], "doc_id bigint, lang string, text string")
    r = D.judge(docs).first()
    assert (r.n_words, r.base_failed, r.kept, r.char_distance) == (0, True, False, None)
    assert D.judge(docs.limit(0)).collect() == []


def test_a_rare_language_keeps_the_base_verdict(spark):
    rnd = random.Random(9)
    common = {"en": ["the", "of", "and", "to"], "de": ["der", "die", "und", "für"], "fi": ["ja", "on", "ei", "se"]}
    text = lambda lang, n: " ".join(rnd.choice(common[lang]) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)) + "."
    rows = [(i, lang, text(lang, 150)) for i, lang in enumerate(["en", "de"] * 30)]
    rows += [(100, "fi", text("fi", 300)), (101, "fi", "ja " * 100), (102, "en", text("fi", 300))]
    got = {r.doc_id: r for r in D.judge(spark.createDataFrame(rows, "doc_id bigint, lang string, text string")).collect()}
    assert all(got[i].kept for i in [*range(60), 100])
    assert (got[100].char_distance, got[100].word_distance) == (None, None)
    assert not got[101].kept and not got[102].kept      # the base rules hold for it too, and a language with a reference is still judged
    many = [*rows, *((200 + i, "fi", text("fi", 300)) for i in range(10))]
    later = {r.doc_id: r for r in D.judge(spark.createDataFrame(many, "doc_id bigint, lang string, text string")).collect()}
    assert later[100].kept and later[100].word_distance is not None
