"""Quality rules by the divergence of a document from language references.

Every language's reference is two histograms over all of its documents: shares of character classes, and shares of its common words
(words with at least `min_share` of the language's words; all others are one more bin). A document is compared with each reference by
Jensen-Shannon distance (base 2, 0 to 1) and passes if it is near enough to some reference in both histograms. Texts that are too short
for a histogram are not judged by it. Everything is DataFrame functions inside the row; the only shuffles are the references' counts,
which are reduced in the tasks first.

Defined results: null text counts as empty; empty and short texts fail the base rules; a null language has no reference of its own but its
documents are judged against the others; where a document's own language has no reference (too few words of it in the table), or none has, the
base verdict holds and the distances are null, so a rare language is not measured against foreign words; repeated rows are judged alike and count
as often as they occur; very long texts are taken whole, inside the row; an empty table gives no rows; extra columns, also of the names made here, are ignored and, in `judge`, kept unless replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.functions.amounts import bind

from .catalog import query, table

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
# Character classes; what is in none of them is the last class.
CLASSES = [r"\p{Ll}+", r"\p{Lu}+", r"\p{Nd}+", BLANK, r"[.,;:!?'\"()\-]+"]
BUCKETS = 1 << 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def taken(text: Column, pattern: str) -> Column:
    """Code points that the pattern's matches cover."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window which the text has twice or more. A window is its 64-bit hash."""
    def covered(h: Column) -> Column:
        twice = lambda s: F.filter(s, lambda x, j: (F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        at = bind(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        return bind(at, lambda p: F.reduce(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    some = bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))
    return F.when(F.size(w) < 3, F.lit(0).cast("bigint")).otherwise(some)


def base_rules(text: Column) -> Column:
    """A struct of the counts of a text that is not null."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = bind(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    return bind(counts, lambda c: F.struct(
        c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), taken(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"),
        ((c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])).alias("base_failed")))


# ---- histograms --------------------------------------------------------------------------------------------------------------------

def plain_words(text: Column) -> Column:
    """Words as the references count them: lower-cased runs of letters."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def class_counts(text: Column) -> Column:
    """Characters of each class, the last one for all others. A class is looked for in what the classes before it have left."""
    def counted(left: Column, patterns: list[str], so_far: list[Column]) -> Column:
        if not patterns:
            return F.array(*so_far, F.length(left).cast("double"))
        return bind(F.regexp_replace(left, patterns[0], ""), lambda rest: counted(rest, patterns[1:], [*so_far, (F.length(left) - F.length(rest)).cast("double")]))
    return counted(text, CLASSES, [])


def references(docs: DataFrame, text: str = "text", lang: str = "lang", min_share: float = 0.002, min_words: int = 2000) -> list[dict]:
    """One entry for each language with at least `min_words` words: the shares of the character classes and of the common words.

    Common words are counted exactly in two passes: first only buckets of words are counted, and a bucket with less than `min_share` of
    the words holds no common word; then the words of the other buckets. So no table of all words is ever shuffled. The driver gets
    one row for each language and at most 1 / min_share words for each."""
    given = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    by_word = given.select("lang", F.explode(plain_words(F.col("text"))).alias("word"))
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS))
    buckets = by_word.groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    totals_of = buckets.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= min_words)
    heavy = buckets.join(totals_of, "lang").where(F.col("n") >= min_share * F.col("total")).select("lang", "bucket", "total").collect()
    totals = {r.lang: r.total for r in heavy}
    if not totals:
        return []
    common = (by_word.where(bucket.isin(sorted({r.bucket for r in heavy})) & F.col("lang").isin(sorted(totals)))
              .groupBy("lang", "word").agg(F.count("*").alias("n")))
    least = F.lit(0.0)
    for name, total in totals.items():
        least = F.when(F.col("lang") == name, min_share * total).otherwise(least)
    kept = common.where(F.col("n") >= least).collect()
    sums = given.select("lang", class_counts(F.col("text")).alias("c")).groupBy("lang").agg(*[F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)]).collect()
    chars = {r.lang: [r[f"c{i}"] for i in range(len(CLASSES) + 1)] for r in sums}
    return [{"lang": x, "chars": [v / sum(chars[x]) for v in chars[x]], "words": {r.word: r.n / totals[x] for r in kept if r.lang == x}} for x in sorted(totals)]


def part(p: Column, q: Column) -> Column:
    """A bin's part of the Jensen-Shannon divergence."""
    m = (p + q) / 2
    side = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (side(p) + side(q)) / 2


def total(values: Column) -> Column:
    return F.reduce(values, F.lit(0.0), lambda a, b: a + b)


def char_distances(text: Column, refs: list[dict]) -> Column:
    shares = bind(class_counts(text), lambda c: F.transform(c, lambda x: x / total(c)))
    known = F.array(*[F.array(*[F.lit(float(v)) for v in r["chars"]]) for r in refs])
    return bind(shares, lambda p: F.transform(known, lambda q: F.sqrt(F.greatest(F.lit(0.0), total(F.transform(p, lambda x, i: part(x, F.get(q, i))))))))


def word_distances(w: Column, refs: list[dict]) -> Column:
    """The distance of the words `w` from each reference; only words that are common somewhere are looked at one by one."""
    vocabulary = sorted({x for r in refs for x in r["words"]})
    if not vocabulary:
        return F.array(*[F.lit(0.0) for _ in refs])
    share = F.map_from_arrays(F.lit(vocabulary), F.array(*[F.array(*[F.lit(float(r["words"].get(x, 0.0))) for r in refs]) for x in vocabulary]))
    mass = F.array(*[F.lit(float(sum(r["words"].values()))) for r in refs])
    n = F.size(w).cast("double")
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.get(s, j - 1) != F.get(s, j)))
    run = lambda s, at: F.transform(at, lambda j, r: F.struct(
        ((F.coalesce(F.get(at, r + 1), F.size(s)) - j) / n).alias("p"), F.element_at(share, F.get(s, j)).alias("q")))
    known = F.sort_array(F.filter(w, lambda x: x.isin(vocabulary)))
    runs = bind(known, lambda s: F.when(F.size(s) == 0, F.array().cast("array<struct<p:double,q:array<double>>>")).otherwise(bind(starts(s), lambda at: run(s, at))))

    def distance(rs: Column, ref: Column) -> Column:
        mine = F.filter(rs, lambda r: F.get(r["q"], ref) > 0)
        seen = lambda ms: total(F.transform(ms, lambda r: part(r["p"], F.get(r["q"], ref)) - F.get(r["q"], ref) / 2))
        others = lambda ms: part(F.greatest(F.lit(0.0), 1 - total(F.transform(ms, lambda r: r["p"]))), F.greatest(F.lit(0.0), 1 - F.get(mass, ref)))
        return bind(mine, lambda ms: F.sqrt(F.greatest(F.lit(0.0), seen(ms) + F.get(mass, ref) / 2 + others(ms))))
    return bind(runs, lambda rs: F.transform(F.sequence(F.lit(0), F.lit(len(refs) - 1)), lambda i: distance(rs, i)))


# A histogram of few words is far from its reference by chance, so what is allowed is a floor and a part that falls with the root of their number.
MAX_CHARS, MAX_WORDS = (0.15, 0.7), (0.12, 2.6)


def farness(char_distance: float | None, word_distance: float | None, n_words: int) -> float:
    """The greater of the two distances as a share of what is allowed; more than 1 is too far. (The rule for one text, for tests and reports.)"""
    allowed = lambda limit: limit[0] + limit[1] / max(1, n_words) ** 0.5
    return max((char_distance or 0.0) / allowed(MAX_CHARS), (word_distance or 0.0) / allowed(MAX_WORDS))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", max_chars: tuple[float, float] = MAX_CHARS, max_words: tuple[float, float] = MAX_WORDS, min_chars: int = 200, min_words: int = 50,
          refs: list[dict] | None = None) -> DataFrame:
    """`docs` with the base counts, `base_failed`, `char_distance` and `word_distance` (to the reference nearest in both; null where the
    text has fewer than `min_chars` characters or `min_words` words of letters, or its language has no reference) and `kept`."""
    if refs is None:
        refs = references(docs, text, lang)
    t = F.coalesce(F.col(text), F.lit(""))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    judged = F.col(lang).isNull() | F.col(lang).cast("string").isin([r["lang"] for r in refs])
    out = docs.withColumn("_judged", judged).drop(*[c for c in docs.columns if c in made and c != text]).withColumn("_base", bind(t, base_rules))
    if refs:
        allowed = lambda limit, n: limit[0] + limit[1] / F.sqrt(F.greatest(n, F.lit(1)))
        far = lambda cs, vs, n: F.transform(F.sequence(F.lit(0), F.lit(len(refs) - 1)), lambda i: F.struct(
            F.greatest(F.coalesce(F.get(cs, i), F.lit(0.0)) / allowed(max_chars, n), F.coalesce(F.get(vs, i), F.lit(0.0)) / allowed(max_words, n)).alias("far"), F.get(cs, i).alias("c"), F.get(vs, i).alias("v")))
        both = bind(plain_words(t), lambda w: F.struct(F.size(w).alias("n"), F.when(F.size(w) >= min_words, word_distances(w, refs)).alias("v"), F.when(F.length(t) >= min_chars, char_distances(t, refs)).alias("c")))
        near = bind(both, lambda x: F.array_min(far(x["c"], x["v"], x["n"])))
        out = out.withColumn("_near", F.when(~F.col("_base.base_failed") & F.col("_judged"), near))
    else:
        out = out.withColumn("_near", F.lit(None).cast("struct<far:double,c:double,v:double>"))
    return out.select(*[c for c in out.columns if c not in ("_base", "_near", "_judged")], "_base.*", F.col("_near.c").alias("char_distance"), F.col("_near.v").alias("word_distance"),
                      (~F.col("_base.base_failed") & (F.coalesce(F.col("_near.far"), F.lit(0.0)) <= 1.0)).alias("kept"))


@query("op10_divergence_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs).drop("text", "lang")
