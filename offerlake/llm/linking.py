"""Links between sets that meet under keys, without all pairs of a key, and the classes that links make.

A set is a node with the sorted 64-bit hashes of its elements. What travels with a node is its size and a sketch: its elements counted in 128
ranges of the hash order, modulo 256. The summed differences of two sketches are at most the number of elements that only one of the sets has, so a
sketch rules pairs out and never in. What stays is counted exactly: sets are cut into fragments of the hash order, the overlap of a pair is
counted in each fragment by itself, and the counts are summed.

Nodes under one key are first tested against one head each, the node that meets the most others: the original, where the rest are its edited
copies. Keys whose nodes are of one class after that need no more. In the others, the nodes outside of the key's largest class try a head of their own for
as long as that halves their number; then every two nodes of different classes are looked at, a key of many nodes in pairs of blocks, by their
sketches inside the task, so that only pairs leave it that the sketches cannot tell apart from a link. So no link between classes is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from offerlake.operators.graph import components
from offerlake.session import cut

BINS, FRAGMENTS = 128, 8


def sketch(hashes: np.ndarray) -> bytes:
    return np.bincount((hashes >> np.uint64(57)).astype(np.int64), minlength=BINS).astype(np.uint8).tobytes()


def differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The summed differences of sketches (last axis), each taken the shorter way round the modulus."""
    d = x - y
    return np.minimum(d, -d).sum(axis=-1, dtype=np.int64)


def may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, p: int, q: int) -> np.ndarray:
    """Whether sets of these sizes, with at least `apart` elements in one of them only, can share p / q of their union."""
    shared = np.minimum((n + m - apart) // 2, np.minimum(n, m))
    return q * shared >= p * (n + m - shared)


def fragments(node: np.ndarray | list, hashes: list[np.ndarray]) -> pd.DataFrame:
    """Rows (node, fragment, part): each set cut into equal ranges of the hash order; empty parts are left out."""
    out = []
    for i, h in zip(node, hashes):
        at = np.searchsorted(h, np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 64) // FRAGMENTS))
        out += [(i, g, part.view(np.int64)) for g, part in enumerate(np.split(h, at)) if len(part)]
    return pd.DataFrame(out, columns=["node", "fragment", "part"])


def linked(pairs: DataFrame, nodes: DataFrame, parts: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) that share at least p / q of their union. `nodes` has node, n and sketch, `parts` the fragments of `fragments`."""
    @pandas_udf("boolean")
    def open_(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for n, m, x, y in parts:
            tables = [np.frombuffer(b"".join(s), dtype=np.uint8).reshape(-1, BINS) for s in (x, y)]
            yield pd.Series(may_link(n.to_numpy(), m.to_numpy(), differences(*tables), p, q))
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))
    close = cut(pairs.join(side("a"), "a").join(side("b"), "b").where(open_("n_a", "n_b", "sketch_a", "sketch_b")).select("a", "b", "n_a", "n_b"))
    parts = only_wanted(parts, close.select(F.explode(F.array("a", "b")).alias("node")), "node")
    met = close.join(parts.select(F.col("node").alias("a"), "fragment", F.col("part").alias("x")), "a").join(parts.select(F.col("node").alias("b"), "fragment", F.col("part").alias("y")), ["b", "fragment"])
    counted = met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).alias("partial")).groupBy("a", "b", "n_a", "n_b").agg(F.sum("partial").alias("shared"))
    return counted.where(q * F.col("shared") >= p * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def close_pairs(rows: pd.DataFrame, p: int, q: int, step: int = 64) -> pd.DataFrame:
    """Pairs (a, b) of nodes of different roots that meet in a group (key, lo, hi) of `rows` and that their sketches leave open. Where lo and
    hi differ, only nodes of different blocks are paired."""
    order = np.lexsort([rows[c].to_numpy() for c in ("hi", "lo", "key")])
    node, root, n, mine = (rows[c].to_numpy()[order] for c in ("node", "root", "n", "mine"))
    group = np.stack([rows[c].to_numpy()[order] for c in ("key", "lo", "hi")])
    table = np.frombuffer(b"".join(rows["sketch"].iloc[order]), dtype=np.uint8).reshape(-1, BINS)
    cuts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
    found = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(node)]):
        blocks = group[1, a] != group[2, a]
        for i in range(a, b, step):
            j = min(b, i + step)
            some = (root[i:j, None] != root[None, i:b]) & (node[i:j, None] != node[None, i:b])
            some &= np.arange(i, j)[:, None] < np.arange(i, b)[None]
            if blocks:
                some &= mine[i:j, None] != mine[None, i:b]
            some &= may_link(n[i:j, None], n[None, i:b], np.int64(0), p, q)
            x, y = np.nonzero(some)
            for at in range(0, len(x), 1 << 15):
                xs, ys = x[at:at + (1 << 15)] + i, y[at:at + (1 << 15)] + i
                keep = may_link(n[xs], n[ys], differences(table[xs], table[ys]), p, q)
                found.append(np.stack([np.minimum(node[xs[keep]], node[ys[keep]]), np.maximum(node[xs[keep]], node[ys[keep]])]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), dtype=np.int64)
    return pd.DataFrame({"a": pairs[0], "b": pairs[1]})


def across(open_: DataFrame, nodes: DataFrame, p: int, q: int, block: int = 512, at_once: int = 4096) -> DataFrame:
    """Pairs (a, b) of nodes with different `root` that meet under a `key` of `open_` and may link by their sketches. A key of many nodes is dealt
    into blocks of about `block` nodes and every two blocks meet in a group of their own; groups are packed into tasks of about `at_once` rows."""
    many = open_.groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = (open_.join(many, "key").withColumn("mine", F.pmod(F.xxhash64("node", "key"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
             .select("key", "node", "root", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")))
    dealt = cut(dealt.join(nodes.select("node", "n", "sketch"), "node"))
    packs = max(1, dealt.count() // at_once)
    packed = dealt.withColumn("pack", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(packs)))
    return packed.groupBy("pack").applyInPandas(lambda rows: close_pairs(rows, p, q), "a bigint, b bigint").distinct()


def connect(met: DataFrame, nodes: DataFrame, parts: DataFrame, p: int, q: int, block: int = 512) -> DataFrame:
    """Links (a, b), a < b, enough to connect all nodes that share a `key` of `met` (key, node) and at least p / q of their union. Every link is a
    true one."""
    check = lambda pairs: linked(pairs, nodes, parts, p, q)
    sizes = met.groupBy("key").agg(F.count("*").alias("c"))
    weights = met.join(sizes, "key").groupBy("node").agg(F.sum("c").alias("weight"))
    weighed = cut(met.join(weights, "node"))

    def headed(group: DataFrame) -> DataFrame:
        """Each node of a key with its key's head."""
        heads = group.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("head"))
        return group.join(heads, "key").where("node <> head").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()

    found = cut(check(headed(weighed)))
    left, before = weighed, None
    while True:
        # the nodes of keys with more than one class; `root` is a node's class. A key of two nodes is settled by its head.
        rooted = left.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
        each = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
        largest = each.groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("largest"), F.count("*").alias("classes"), F.sum("c").alias("all")).where("classes > 1 and all > 2")
        open_ = cut(rooted.join(largest.select("key", "largest"), "key"))
        apart = open_.where("root <> largest")
        now = apart.count()
        if not now:
            return found
        if before is not None and 2 * now > before:
            return found.unionByName(cut(check(across(open_.select("key", "node", "root"), nodes, p, q, block))))
        before, left = now, open_.select("key", "node", "weight")
        found = cut(found.unionByName(check(headed(apart))).distinct())


def only_wanted(texts: DataFrame, wanted: DataFrame, key: str, at_most: int = 2_000_000) -> DataFrame:
    """The rows of `texts` whose `key`, a 64-bit hash, is one of the distinct ones of `wanted`. Up to `at_most` of them (about 50 MB) are sent to the
    tasks, so that other texts are never shuffled; more than that are joined by a shuffle, with the same rows."""
    some = cut(wanted.select(key).distinct())
    return texts.join(F.broadcast(some) if some.count() <= at_most else some, key, "left_semi")


def parts_of(texts: DataFrame, hashes: Callable[[str | None], np.ndarray]) -> DataFrame:
    """The fragments of the sets of `texts` (node, text)."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 128):        # results leave in small batches
                some = batch.iloc[at:at + 128]
                yield fragments(some["node"].tolist(), [hashes(t) for t in some["text"]])
    return texts.select("node", "text").mapInPandas(each, "node bigint, fragment int, part array<bigint>")
