"""Quality scores by histogram gradient-boosted trees over document statistics.

The statistics of a text are worked out from the whole of it on the executors. Trees are grown on the driver from a sample of at most
`max_rows` labelled rows: statistics are cut into at most 64 bins, every level of a tree sums gradients in histograms of (node, statistic,
bin). All trees have the same depth, so a model is three arrays (statistic, threshold, leaf value) in heap order, and a batch of documents
walks all trees at once, one level a step.

Defined results: null text counts as empty and is scored like any other; with labels of one kind only (or none) every score is the share
of that kind (or 0.5); a document with several labels counts once for each; other columns are never looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .catalog import query, table

STATISTICS = ["log_chars", "log_words", "word_length", "lower", "upper", "digits", "blank", "ending", "shouting", "symbols", "other", "log_lines", "line_words", "repeated_lines",
              "distinct_words", "top_word", "bare_words", "capital_words", "longest_word", "word_entropy", "echoes"]
LOWER, UPPER, DIGIT, BLANK, ENDING, SHOUT, SYMBOL, OTHER = range(8)
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The character class of every code point."""
    def of(c: str) -> int:
        if c.isspace():
            return BLANK
        if c.isalpha():
            return UPPER if c.isupper() else LOWER
        return DIGIT if c.isdigit() else SHOUT if c == "!" else ENDING if c in ".,;:?" else SYMBOL if c in "#*$%&|<>" else OTHER
    return np.fromiter((of(chr(i)) for i in range(0x110000)), dtype=np.uint8, count=0x110000)


def statistics(text: str | None) -> list[float]:
    text = text or ""
    counts = np.zeros(8, dtype=np.int64)
    for at in range(0, len(text), CHUNK):
        counts += np.bincount(classes()[np.frombuffer(text[at:at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)], minlength=8)
    chars, words, lines = max(1, len(text)), text.split(), [x for x in text.split("\n") if x.strip()]
    n, many = max(1, len(words)), Counter(words)
    share = counts / chars
    letters = int(counts[LOWER] + counts[UPPER])
    entropy = -sum(c / n * math.log2(c / n) for c in many.values())
    return [math.log1p(len(text)), math.log1p(len(words)), sum(map(len, words)) / n, share[LOWER], counts[UPPER] / max(1, letters), share[DIGIT], share[BLANK], share[ENDING], share[SHOUT],
            share[SYMBOL], share[OTHER], math.log1p(len(lines)), len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(many) / n, max(many.values(), default=0) / n,
            sum(c for w, c in many.items() if not w.isalpha()) / n, sum(c for w, c in many.items() if w[0].isupper()) / n, min(200, max(map(len, many), default=0)), entropy,
            sum(a == b for a, b in zip(words, words[1:])) / n]


# ---- trees -------------------------------------------------------------------------------------------------------------------------

def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, reg: float = 1.0, least: float = 1e-3) -> dict:
    """Trees for labels 0/1 with logistic loss, flattened: statistic and threshold of every inner node, value of every leaf."""
    rows, width = x.shape
    prior = float(np.clip(y.mean() if rows else 0.5, 1e-6, 1 - 1e-6))
    model = {"base": math.log(prior / (1 - prior)), "depth": depth, "stat": np.zeros((0, 2 ** depth - 1), dtype=np.int32), "at": np.zeros((0, 2 ** depth - 1)), "leaf": np.zeros((0, 2 ** depth))}
    if rows == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)   # bin b: edges[b-1] < x <= edges[b]
    margin, out = np.full(rows, model["base"]), {"stat": [], "at": [], "leaf": []}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(rows, dtype=np.int64)
        stat, at = np.zeros(2 ** depth - 1, dtype=np.int32), np.full(2 ** depth - 1, np.inf)
        for level in range(depth):
            width_of, first = 2 ** level, 2 ** level - 1
            slot = ((node[:, None] * width + np.arange(width)) * bins + binned).ravel()
            gs = np.bincount(slot, np.repeat(g, width), width_of * width * bins).reshape(width_of, width, bins).cumsum(axis=2)
            hs = np.bincount(slot, np.repeat(h, width), width_of * width * bins).reshape(width_of, width, bins).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs ** 2 / (hs + reg) + (gt - gs) ** 2 / (ht - hs + reg) - gt ** 2 / (ht + reg)
            gain[(hs < least) | (ht - hs < least)] = 0
            best = gain.reshape(width_of, -1).argmax(axis=1)
            for k in range(width_of):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    stat[first + k], at[first + k] = j, edges[j][b]
            node = 2 * node + (x[np.arange(rows), stat[first + node]] > at[first + node])
        leaf = -rate * np.bincount(node, g, 2 ** depth) / (np.bincount(node, h, 2 ** depth) + reg)
        margin = margin + leaf[node]
        for name, value in (("stat", stat), ("at", at), ("leaf", leaf)):
            out[name].append(value)
    return model | {name: np.stack(v) for name, v in out.items()}


def walk(x: np.ndarray, model: dict) -> np.ndarray:
    """Scores of the rows: every row goes down all trees together."""
    trees = np.arange(len(model["stat"]))
    node = np.zeros((len(x), len(trees)), dtype=np.int64)
    rows = np.arange(len(x))[:, None]
    for level in range(model["depth"] if len(trees) else 0):
        inner = 2 ** level - 1 + node
        node = 2 * node + (x[rows, model["stat"][trees, inner]] > model["at"][trees, inner])
    return 1 / (1 + np.exp(-(model["base"] + model["leaf"][trees, node].sum(axis=1))))


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, text: str, doc_id: str, label: str, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `max_rows` usable labelled rows, drawn by a hash of the id. The drawn labels are few by that
    bound, so they are sent to the documents and no text is moved."""
    marked = labels.where(usable & F.col(label).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_label"))
    n = marked.count()
    drawn = marked.where(F.pmod(F.xxhash64("_id", F.lit("quality")), F.lit(1 << 30)) < min(1.0, max_rows / max(1, n)) * (1 << 30)).limit(max_rows + max_rows // 4)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(drawn), "_id").select("_id", "_text", "_label")

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"id": part["_id"], "label": part["_label"], "x": [statistics(t) for t in part["_text"]]})
    got = rows.mapInPandas(measured, "id bigint, label double, x array<double>").toPandas().sort_values(["id", "label"], kind="stable")
    x = np.array([*got["x"]], dtype=np.float64).reshape(-1, len(STATISTICS))
    return x, got["label"].to_numpy(dtype=np.float64)


def score(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_rows: int = 20_000, into: str = "score") -> DataFrame:
    """`docs` with the score `into` a column; one of that name is replaced. Only labels of `usable` rows are learned from."""
    model = grow(*labelled_sample(docs, labels, usable, text, doc_id, label, max_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            x = np.array([statistics(t) for t in part], dtype=np.float64).reshape(-1, len(STATISTICS))
            yield pd.Series(np.concatenate([walk(x[i:i + 1000], shared.value) for i in range(0, len(x), 1000)] or [np.empty(0)]))
    return docs.withColumn(into, scored(F.col(text)))


@query("op5_quality_gbt")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
