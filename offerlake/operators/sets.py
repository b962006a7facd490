"""Set operations between results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import rounded


def set_union_kinds(**kinds: DataFrame) -> DataFrame:
    """Offers of several kinds in one schema; a column a kind lacks is null there."""
    parts = [df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def set_missing_items(items: DataFrame, hits: DataFrame, on: Sequence[str]) -> DataFrame:
    """The items no search has returned."""
    return items.join(hits.select(*on).distinct(), list(on), "left_anti")


def set_covered_ads(at: DataFrame) -> DataFrame:
    """Per area and seller, how many of its ads no earlier area covers, and whether a search there is needed. Needs
    area, ord (the areas' order), seller, ad."""
    one = at.groupBy("seller", "ad", "area").agg(F.min("ord").alias("ord"))
    first = one.groupBy("seller", "ad").agg(F.min("ord").alias("first"))
    return (one.join(first, ["seller", "ad"]).groupBy("area", "seller")
            .agg(F.count_if(F.col("ord") == F.col("first")).alias("new_ads"))
            .withColumn("search", F.col("new_ads") > 0))


def set_shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many distinct rows each side has, how many both have, and the share of each side that is. One pass: a row's
    sides are gathered by key instead of intersecting two shuffled sets."""
    cols = a.columns
    sides = (a.withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0))
             .unionByName(b.withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
             .groupBy(*cols).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")))
    n = sides.agg(F.sum("_a").alias("a_rows"), F.sum("_b").alias("b_rows"), F.count_if(F.expr("_a = 1 AND _b = 1")).alias("shared"))
    return n.withColumns({"a_share": rounded(F.col("shared") / F.col("a_rows"), 3),
                          "b_share": rounded(F.col("shared") / F.col("b_rows"), 3)})
