"""Similarity join of documents by the Jaccard likeness of their word n-grams, with vertical partitioning.

The order of the 64-bit hashes is the global order of the n-grams. It is cut into fragments, and a document's set falls into one segment in each.
Two sets that share p / q of their union differ in at most (n + m)(q - p)/(q + p) n-grams, so with more fragments than that they agree wholly in
one segment at least: sets meet under the hashes of their segments. How many fragments there are hangs on the size alone: sizes are cut into ranges, a
pair meets in the range of its larger set, and a set also comes to the next range if it is large enough to have partners there. For the pairs
that meet, the overlap is counted fragment by fragment (coarser ones, the same for all) and summed per pair, exactly. How a key of many sets is settled
without all its pairs is told in `linking`.

A set with an empty segment could agree with another in nothing else; such sets are cut again by another order, and so on; what is still
empty in the last order is a key like any other, so no pair is lost.

Equal sets are one node from the start, so copies never make pairs. Two nodes are told apart by 64 bits of their sets' hash; sets that meet in
these are told apart by a second hash.

Defined results: null, empty and blank texts have no n-grams and are linked with nothing, themselves their class; fewer words than n make one n-gram of
all words; repeated rows are one node and each comes back; a null id is in its class but never names it (a class of null ids alone has a null id); very
long texts are taken whole, in memory in proportion to their words; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from offerlake.session import cut

from . import linking
from .catalog import query, table

U = np.uint64
ORDERS = 6
SPREAD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]      # odd multipliers


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits spread over 64 bits, one to one."""
    x = (x ^ (x >> U(32))) * U(SPREAD[3])
    x = (x ^ (x >> U(29))) * U(SPREAD[1])
    return x ^ (x >> U(32))


def ngrams(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the text's n-grams of words; of all its words together if they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=U)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=U, count=len(words))
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, dtype=U)
    for i in range(width):
        out = mixed(out * U(SPREAD[0]) + each[i:len(words) - width + 1 + i])
    return np.unique(out)


@lru_cache(None)
def ranges(p: int, q: int, upto: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Where the size ranges begin, and how many fragments each has: one more than two sets of the range can differ in."""
    edges = [1]
    while edges[-1] < upto:
        edges.append(max(edges[-1] * 7 // 5, edges[-1] * q // p) + 1)
    return np.array(edges), np.array([2 * (b - 1) * (q - p) // (q + p) + 1 for b in edges[1:]])


def segment_keys(hashes: np.ndarray, p: int, q: int) -> np.ndarray:
    """The hashes of a set's segments, for each size range in which it can have partners."""
    n, keys = len(hashes), []
    if not n:
        return np.empty(0, dtype=np.int64)
    edges, counts = ranges(p, q)
    at = lambda size: int(np.searchsorted(edges, size, "right")) - 1
    for r in range(at(n), at(n * q // p) + 1):
        f = int(counts[r])
        if f == 1:
            continue            # only equal sets are alike enough
        for order in range(ORDERS):
            ranked = hashes if not order else np.sort(mixed(hashes + U(order * SPREAD[2] % (1 << 64))))
            fragment = ((ranked >> U(32)) * U(f) >> U(32)).astype(np.int64)
            starts = np.flatnonzero(np.diff(fragment, prepend=-1))
            salt = U(((r * ORDERS + order) << 40) % (1 << 64))
            keys.append(mixed(mixed(np.add.reduceat(mixed(ranked ^ U(SPREAD[1])), starts)) + salt + fragment[starts].astype(U)))
            if len(starts) == f:
                break
            if order == ORDERS - 1:
                keys.append(mixed(np.setdiff1d(np.arange(f), fragment[starts]).astype(U) + salt + U(1 << 39)))
    return np.concatenate(keys).view(np.int64) if keys else np.empty(0, dtype=np.int64)


def node_sets(docs: DataFrame, text: str, doc_id: str, size: int, p: int, q: int) -> DataFrame:
    """doc_id, mark (hash of the text), n, node and check (hashes of the set), sketch and keys."""
    @pandas_udf("n int, node bigint, check bigint, sketch binary, keys array<bigint>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, max(1, len(part)), 256):
                rows = []
                for t in part.iloc[at:at + 256]:
                    h = ngrams(t, size)
                    raw = h.tobytes()
                    rows.append((len(h), xxhash.xxh64_intdigest(raw) - (1 << 63), xxhash.xxh64_intdigest(raw, 1) - (1 << 63), linking.sketch(h), segment_keys(h, p, q)))
                yield pd.DataFrame(rows, columns=["n", "node", "check", "sketch", "keys"])
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.md5(F.col(text)).alias("mark"), of(F.col(text)).alias("x")).select("doc_id", "mark", "x.*")


def told_apart(rows: DataFrame) -> DataFrame:
    """`rows` with another node for sets that share their node with a set of another check. Such sets are almost never there."""
    shared = cut(rows.groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most")).where("least < most").select("node", "least"))
    if shared.isEmpty():
        return rows
    return cut(rows.join(shared, "node", "left").withColumn("node", F.when(F.col("check") != F.col("least"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("least"))


def similar_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 3, p: int = 90, q: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the least doc_id that can be reached by links of at least p / q."""
    rows = told_apart(cut(node_sets(docs, text, doc_id, size, p, q)))
    postings = rows.select("node", F.explode("keys").alias("key"))
    shared = postings.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    met = cut(postings.join(shared, "key").distinct())
    wanted = cut(rows.join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("mark").alias("mark"), F.min("n").cast("bigint").alias("n"), F.min(F.hex("sketch")).alias("sketch"))
                 .withColumn("sketch", F.unhex("sketch")))
    marked = wanted.select("mark", "node", F.xxhash64("mark").alias("short"))
    texts = docs.select(F.md5(F.col(text)).alias("mark"), F.col(text).alias("text")).withColumn("short", F.xxhash64("mark"))
    texts = linking.only_wanted(texts, marked, "short").join(marked, ["short", "mark"]).dropDuplicates(["node"])
    parts = cut(linking.parts_of(texts, lambda t: ngrams(t, size)))
    links = linking.connect(met, wanted, parts, p, q)
    roots = linking.components(links)
    firsts = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = firsts.join(firsts.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
    some = rows.where("n > 0").select("doc_id", "n", "node").join(named, "node").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")
    none = rows.where("n = 0").select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


@query("op13_ngram_join")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
