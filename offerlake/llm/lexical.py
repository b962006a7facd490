"""Ranked lexical search of a set of items over all documents, by classes of documents that the items cannot tell apart.

A document is restricted to the items' vocabulary: its bag is the vector of its counts of those terms. With the whole-number length norm m, the
bag decides every score, so documents with equal bag and m are one class: classes are grouped by a hash of the bag, and by m and the bag
itself, which verifies the hash. A class is scored once, against all items of a block, as a product of its terms' parts with a matrix of the items'
weights; a task keeps its k best classes for each item, which is enough: a document of any other class has k documents before it, one of
each better class. Only the classes that win are expanded into their members, by ascending id.

Items are taken in blocks, so that vocabulary and matrix sent to the tasks are bounded (`cells`) however many items there are; each block is asked of
all documents.

Defined results: a null or blank text has no terms: such a document is not counted and never found, such an item gets no rows; items that repeat are
ranked each for itself; repeated documents are documents of their own; a null doc_id comes after all others of its score; equal scores are ranked by
ascending doc_id; a text that is very long is read whole; empty tables give no rows; extra columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from offerlake.session import cut

from .catalog import query, table

# ASCII but for digits and letters parts terms; A-Z become a-z; bytes from 0x80 on belong to terms.
AS_TERMS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
LAST = (1 << 63) - 1


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(AS_TERMS).split()


def blocks(items: DataFrame, item_id: str, text: str, cells: int) -> Iterator[list[tuple]]:
    """(item id, its terms with their counts), in blocks whose items times distinct terms are within `cells` (or single items)."""
    held, seen = [], set()
    for row in items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).toLocalIterator():
        bag = Counter(terms(row["text"]))
        if not bag:
            continue
        if held and (len(held) + 1) * len(seen | bag.keys()) > cells:
            yield held
            held, seen = [], set()
        held.append((row["item"], bag))
        seen |= bag.keys()
    if held:
        yield held


def bags(docs: DataFrame, text: str, doc_id: str, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text), and the bag: the vocabulary's terms in it (`at`), how often each occurs (`tf`), and a hash of both."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    @pandas_udf("n bigint, hash bigint, at array<int>, tf array<int>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        number = shared.value.get
        for part in parts:
            rows = []
            for given in part:
                all_ = terms(given)
                at, tf = np.unique(np.array([i for i in map(number, all_) if i is not None], dtype=np.int32), return_counts=True)
                tf = tf.astype(np.int32)
                rows.append((len(all_), xxhash.xxh64_intdigest(at.tobytes() + tf.tobytes()) - (1 << 63), at, tf))
            yield pd.DataFrame(rows, columns=["n", "hash", "at", "tf"])
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), of(F.col(text)).alias("bag")).select("doc_id", "bag.*").where("n > 0")


BAG = ["m", "hash", "at", "tf"]


def best_classes(classes: DataFrame, weights: np.ndarray, k: int) -> DataFrame:
    """(item, score, first, bag) of the `k` classes that each task finds best for each item: by score, then by the least doc_id in them."""
    shared = classes.sparkSession.sparkContext.broadcast(weights)
    schema = "item int, score bigint, first bigint, m bigint, hash bigint, at array<int>, tf array<int>"

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        n_items = weights.shape[1]
        tops: list[list[tuple]] = [[] for _ in range(n_items)]       # for each item (-score, first, number of the class), best first
        kept: dict[int, tuple] = {}
        number = 0
        for part in parts:
            m, firsts = part["m"].to_numpy(), part["first"].to_numpy()
            scores = np.empty((len(part), n_items), dtype=np.int64)
            for i, (at, tf) in enumerate(zip(part["at"], part["tf"])):
                times = np.asarray(tf, dtype=np.int64)
                scores[i] = ((1_000_000_000 * times) // (1000 * times + 8 * m[i])) @ weights[np.asarray(at)]
            new = set()
            for item in range(n_items):
                column, top = scores[:, item], tops[item]
                least = -top[-1][0] if len(top) == k else 1
                some = np.flatnonzero(column >= max(1, least))
                if len(some):
                    some = some[np.lexsort((firsts[some], -column[some]))[:k]]
                    tops[item] = sorted(top + [(-int(column[i]), int(firsts[i]), number + int(i)) for i in some])[:k]
                    new.update(x[2] - number for x in tops[item] if x[2] >= number)
            for i in new:
                kept[number + i] = (int(m[i]), int(part["hash"].iat[i]), part["at"].iat[i], part["tf"].iat[i])
            number += len(part)
            live = {x[2] for top in tops for x in top}
            kept = {x: bag for x, bag in kept.items() if x in live}
        for item, top in enumerate(tops):
            if top:
                yield pd.DataFrame([(item, -x[0], x[1], *kept[x[2]]) for x in top], columns=["item", "score", "first", *BAG])
    return classes.select("first", *BAG).mapInPandas(each, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", b: int = 75, cells: int = 4_000_000) -> DataFrame:
    """item_id, rank, doc_id, score of the `k` documents with the highest scores above 0 for each item. `b` is how much of a hundredth the length
    of a document counts."""
    spark = docs.sparkSession
    found = []
    for block in blocks(items, item_id, item_text, cells):
        vocabulary = sorted(set().union(*(bag.keys() for _, bag in block)))
        numbers = {t: i for i, t in enumerate(vocabulary)}
        held = cut(bags(docs, text, doc_id, numbers))
        total = held.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not total.docs:
            break
        df = {r["at"]: r["df"] for r in held.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).collect()}      # a row for each term of the block
        weights = np.zeros((len(vocabulary), len(block)), dtype=np.int64)
        for column, (_, bag) in enumerate(block):
            for t, times in bag.items():
                at = numbers[t]
                weights[at, column] = times * math.floor(1000 * math.log((2 * total.docs + 2) / (2 * df.get(at, 0) + 1)))
        normed = held.where(F.size("at") > 0).withColumn("m", F.expr(f"{100 - b} + (({b} * n * {total.docs}L) div {total.terms}L)"))
        classes = normed.groupBy(*BAG).agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("first"))
        per_task = best_classes(classes, weights, k)
        won = cut(per_task.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "first"))).where(F.col("place") <= k))
        winners = won.select("first", *BAG).distinct()          # at most k for each item of the block
        by_id = Window.partitionBy("first", *BAG).orderBy(F.asc_nulls_last("doc_id"))
        members = normed.join(F.broadcast(winners), BAG).withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k).select("first", *BAG, "doc_id")
        names = spark.createDataFrame([(i, x[0]) for i, x in enumerate(block)], items.select(F.lit(0).alias("item"), F.col(item_id).alias("item_id")).schema)
        ranked = won.join(members, ["first", *BAG]).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
        found.append(cut(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")))
    if not found:
        return spark.createDataFrame([], items.select(F.col(item_id).alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERMS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_lexical_search", f"""
WITH words AS (SELECT doc_id, {TERMS_SQL} AS ws FROM documents),
total AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS terms FROM words WHERE len(ws) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM words) GROUP BY ALL),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf SEMI JOIN asked USING (term) GROUP BY term),
parts AS (SELECT item_id, doc_id, times * CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))) AS part
          FROM asked JOIN tf USING (term) JOIN df USING (term), total),
scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM parts GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
