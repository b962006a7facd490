"""Cutting a whole-number key into ranges that every run finds again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.functions.amounts import bind


def range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted `cuts` are at or below `value`, by a coarse and a fine step (about the square root of their number each)."""
    step = max(1, round(len(cuts) ** 0.5))
    fine = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    longs = lambda xs: F.lit(xs).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= value))
    if not cuts:
        return F.lit(0)
    block = below(longs([x[0] for x in fine])) - 1
    return bind(block, lambda b: F.when(b < 0, 0).otherwise(b * step + below(F.get(F.array(*[longs(x) for x in fine]), b))))


def even_cuts(rows: DataFrame, target: int) -> list[int]:
    """Where ranges of `key` begin, each with about `target` of the summed `weight`, the same however the rows are spread.

    Equal-width cells are weighed; a cell that is too heavy is cut into cells again, until it is light enough or one key. The driver gets
    a few cells for each range that comes out."""
    all_ = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("weight").alias("w")).first()
    if all_.lo is None:
        return []
    heavy, cells = [(all_.lo, all_.hi, int(all_.w or 0))], []
    while heavy:
        heavy.sort()
        widths = [max(1, -(-(hi - lo + 1) // (4 * -(-max(w, 1) // target) + 16))) for lo, hi, w in heavy]
        longs = lambda xs: F.lit(xs).cast("array<bigint>")
        at = F.get(longs([x[0] for x in heavy]), F.col("r") - 1)
        cell = F.floor((F.col("key") - at).cast("decimal(20,0)") / F.get(longs(widths), F.col("r") - 1).cast("decimal(20,0)")).cast("bigint")
        got = (rows.withColumn("r", range_of(F.col("key"), [x[0] for x in heavy])).where((F.col("r") > 0) & (F.col("key") <= F.get(longs([x[1] for x in heavy]), F.col("r") - 1)))
               .groupBy("r", cell.alias("cell")).agg(F.sum("weight").alias("w")).collect())
        nxt = []
        for x in got:
            lo, hi, _ = heavy[x.r - 1]
            width = widths[x.r - 1]
            first = lo + x.cell * width
            (nxt if x.w > target and width > 1 else cells).append((first, min(hi, first + width - 1), int(x.w)))
        heavy = nxt
    cuts, filled = [], None
    for lo, _, w in sorted(cells):
        if filled is None or filled + w > target:
            cuts.append(lo)
            filled = 0
        filled += w
    return cuts
