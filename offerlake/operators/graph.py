"""Classes that links make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, root being the least node it can reach. Alternates large-star and small-star (Kiveris et al. 2014)
    until all links are stars; the number of rounds grows with the logarithm of the longest chain. Needs a, b."""
    def stars(sym: DataFrame, keep: Column) -> DataFrame:
        """Of the links (u, v) of each u: its least neighbour or itself, m, and the links to m of the neighbours that `keep` names."""
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return sym.join(least, "u").where(keep).select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).where("a <> b")

    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    size = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    before = size(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = cut(stars(both, F.col("v") > F.col("u")).distinct())
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = cut(small.distinct())
        after = size(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
