"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint has bit b set if over half of its shingles' hashes have it set. Two fingerprints that differ in at most `d` bits
agree in at least `blocks - d` of `blocks` blocks, so they meet under the key of those blocks; the pairs of a key are then verified by
Hamming distance. Equal fingerprints are one from the start, so copies never make pairs. A key with more than `small` fingerprints makes
no pairs either: each of its fingerprints is listed under the words one bit away from it (in the bits outside the key), and two
fingerprints within two bits share such a word. That finds the same links through words instead of pairs and grows with the
number of fingerprints only. Links become classes by alternating large-star and small-star steps (`graph.components`).

Defined results: a null or blank text has fingerprint zero and is linked like any other; fewer words than a shingle make one shingle
of all words; repeated rows have the same fingerprint and class; a very long text is taken whole, in memory in proportion to its length; an
empty table gives no rows; the id may be any integer type; extra
columns, also of the names made here, are left out of the result of `near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from offerlake.operators.graph import components
from offerlake.session import cut

from . import linking
from .catalog import query, table
from .ngram_join import ngrams

CHUNK = 1 << 16


def simhash(text: str | None, shingle: int) -> int:
    """The fingerprint as a signed 64-bit number. `bytes.split` cuts at space, tab, line feed, vertical tab, form feed and return."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist())
    ones = np.zeros(64, dtype=np.int64)
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), dtype=np.uint64, count=n)
    for at in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[at:at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int = 3) -> Column:
    @pandas_udf("bigint")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([simhash(t, shingle) for t in part], dtype="int64")
    return of(text)


def block_keys(fp: Column, bits: int, blocks: int) -> Column:
    """For each choice of the blocks that must agree: the choice's number and the fingerprint with all other bits cleared."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - bits)):
        mask = sum((1 << edges[b + 1]) - (1 << edges[b]) for b in chosen)
        keys.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(signed(mask))).alias("key"), F.lit(signed(~mask)).alias("rest")))
    return F.array(*keys)


def signed(word: int) -> int:
    word %= 1 << 64
    return word - (1 << 64) if word >> 63 else word


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, bits: int = 2, blocks: int = 4, small: int = 24) -> DataFrame:
    """Links (a, b), a < b, of the distinct fingerprints `fp`, enough to connect all that are within `bits` (1 or 2) of each other.
    Every link is a true one."""
    if bits not in (1, 2):
        raise ValueError("fingerprints link at one or two bits")
    keyed = fps.select("fp", F.inline(block_keys(F.col("fp"), bits, blocks)))
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n"))
    crowded = cut(sizes.where(F.col("n") > small).select("choice", "key"))
    shared = cut(sizes.where(F.col("n").between(2, small)).select("choice", "key"))

    # few in a key: arrays of at most `small`, their pairs verified
    few = keyed.join(shared, ["choice", "key"], "left_semi").groupBy("choice", "key").agg(F.sort_array(F.collect_list("fp")).alias("all"))
    pair = F.transform("all", lambda a, i: F.transform(F.filter(F.slice("all", i + 2, small), lambda b: distance(a, b) <= bits),
                                                       lambda b: F.struct(a.alias("a"), b.alias("b"))))
    pairs = few.select(F.inline(F.flatten(pair)))

    # many in a key: a fingerprint and its neighbours at one bit; all that share such a word are within two bits of each other
    word_of = lambda fp, rest: F.concat(F.array(fp), F.transform(F.filter(F.array(*[F.lit(signed(1 << b)) for b in range(64)]), lambda bit: bit.bitwiseAND(rest) != 0), lambda bit: fp.bitwiseXOR(bit)))
    many = keyed.join(crowded, ["choice", "key"], "left_semi")
    if bits == 2:
        words = many.select("fp", F.explode(word_of(F.col("fp"), F.col("rest"))).alias("word"))
        # one choice's words differ from another's only by which bits may change, so a word stands for itself whatever the choice
        heads = words.groupBy("word").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("word", "a")
        far = words.join(heads, "word").where("fp > a").select("a", F.col("fp").alias("b"))
    else:
        flips = many.select("fp", F.explode(F.array(*[F.lit(signed(1 << b)) for b in range(64)])).alias("bit"), "rest").where(F.col("bit").bitwiseAND(F.col("rest")) != 0)
        far = flips.select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("other")).join(fps.select(F.col("fp").alias("other")), "other").select(
            F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    return pairs.unionByName(far).distinct()


def classes(fps: DataFrame, bits: int = 2, blocks: int = 4) -> DataFrame:
    """(fp, component_id) from the rows (doc_id, fp): the least doc_id that a fingerprint can reach."""
    firsts = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(links(firsts.select("fp"), bits, blocks))
    rooted = firsts.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc_id, fp), worked out once and kept in the shared folder."""
    return cut(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, bits: int = 2, blocks: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    fps = fingerprints(docs, text, doc_id, shingle)
    return fps.join(classes(fps, bits, blocks), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies by shared shingles ------------------------------------------------------------------------------------------------
# Texts that share four fifths of their five-word shingles differ in five to ten bits, which no split into blocks finds at a bearable price.
# For deduplication their candidates come from bands of minimum hashes; `linking` settles each band key exactly, on the whole shingle sets.

BANDS, ROWS, WORDS = 20, 5, 5


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band: sets that agree in all minimum hashes of a band have the same."""
    rnd = np.random.default_rng(4)
    by = rnd.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        x = hashes[at:at + 1024][None, :] * by[:, None]
        np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def marks_of(text: Column, shingle: int, with_bands: bool) -> Column:
    """The fingerprint of a text, and of the set of its five-word shingles the size, the sketch and the keys of its bands."""
    @pandas_udf("fp bigint, n bigint, sketch binary, bands array<bigint>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        none = np.empty(0, dtype=np.uint64)
        for part in parts:
            for at in range(0, max(1, len(part)), 256):     # results leave in small batches
                out = []
                for t in part.iloc[at:at + 256]:
                    h = ngrams(t, WORDS) if with_bands else none
                    out.append((simhash(t, shingle), len(h), linking.sketch(h), band_keys(h) if len(h) else none.view(np.int64)))
                yield pd.DataFrame(out, columns=["fp", "n", "sketch", "bands"])
    return of(text)


def near_copies(docs: DataFrame, rows: DataFrame, text: str, at_least: float, block: int = 512) -> DataFrame:
    """Links (a, b) between the marks of texts that share at least `at_least` of their five-word shingles, enough to connect all such texts
    that meet in a band. `rows` has mark, n, sketch and bands. Every link is a true one. Copies of a text are one mark."""
    share = Fraction(at_least).limit_denominator(1000)
    postings = rows.select(F.col("mark").alias("node"), F.explode("bands").alias("key"))
    shared = postings.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    met = cut(postings.join(shared, "key").distinct())
    nodes = cut(rows.withColumnRenamed("mark", "node").join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    texts = linking.only_wanted(docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("node"), F.col(text).alias("text")), nodes, "node").dropDuplicates(["node"])
    parts = cut(linking.parts_of(texts, lambda t: ngrams(t, WORDS)))
    return linking.connect(met, nodes, parts, share.numerator, share.denominator, block)


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, bits: int = 2, blocks: int = 4, at_least: float | None = 0.8) -> DataFrame:
    """The rows of `docs` that stay: of each class the row with the least id. Classes are those of the fingerprints, joined where texts
    share `at_least` of their five-word shingles (None: fingerprints only). Rows that repeat the one that stays (id and text) go as well;
    of rows with that id but other texts of the class, the one with the least fingerprint and hash stays."""
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = cut(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), mark.alias("mark"), marks_of(F.col(text), shingle, at_least is not None).alias("m")).select("doc_id", "mark", "m.*"))
    texts = rows.groupBy("mark", "fp").agg(F.min("doc_id").alias("doc_id"))
    roots = components(links(rows.select("fp").distinct(), bits, blocks)).withColumnRenamed("node", "fp")
    rooted = cut(texts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    if at_least is not None:
        root_of = rooted.select("mark", "root")
        copies = near_copies(docs, rows, text, at_least).join(root_of.select(F.col("mark").alias("a"), F.col("root").alias("ra")), "a").join(root_of.select(F.col("mark").alias("b"), F.col("root").alias("rb")), "b")
        wider = components(copies.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("wide"))
        rooted = rooted.join(wider, "root", "left").withColumn("root", F.coalesce("wide", "root"))
    # rows with an id come before those without
    stay = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "fp", "mark")).alias("x")).select("x.doc_id", "x.mark")
    there = docs.withColumns({"_stay_id": F.col(doc_id).cast("bigint"), "_stay_mark": mark})
    kept = there.join(stay, F.col("_stay_id").eqNullSafe(stay["doc_id"]) & (F.col("_stay_mark") == stay["mark"]), "left_semi")
    return kept.dropDuplicates(["_stay_id", "_stay_mark"]).drop("_stay_id", "_stay_mark")


@query("op4_simhash_blocks")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
