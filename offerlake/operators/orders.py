"""Orders of result lists, with the id as last key so the order is total, and the picks made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fn_norm


def local_order(last: str = "id") -> list[Column]:
    return [F.col("score").desc(), F.coalesce(F.col("savings"), F.lit(0.0)).desc(), F.col("title").asc(), F.col(last).asc()]


def srt_local(df: DataFrame) -> DataFrame:
    return df.orderBy(*local_order())


def srt_promotions(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("score").desc(), F.col("ends_in_days").asc(), F.col("title").asc(), F.col("id").asc())


def srt_regular(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("starts_in_days").asc(), F.col("score").desc(), F.col("merchant").asc(), F.col("title").asc(),
                      F.col("id").asc())


def srt_sales(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("score").desc(), F.col("ends_at").asc_nulls_last(), F.lower("store_name").asc(), F.col("id").asc())


def srt_city_search(areas: DataFrame, wanted: str, n: int = 10) -> DataFrame:
    """The n places a few typed letters may mean: names that start with them, then names that hold them, larger first."""
    key = fn_norm(F.regexp_replace(F.lit(wanted), r"(?i),?\s*(tx|texas)$", ""))
    name = fn_norm(F.col("name"))
    ranked = areas.withColumn("match", F.when(name.startswith(key), 0).when(name.contains(key), 1))
    return (ranked.where("match IS NOT NULL")
            .orderBy("match", F.coalesce("population", F.lit(0)).desc(), "id").limit(n))


def srt_pick_nine(pool: DataFrame, now: Column, n: int = 9, per_kind: int = 3, page: int = 3) -> DataFrame:
    """The n biggest of a pool live at `now`: one per brand and `per_kind` of a kind while other kinds have some, then
    the best of the rest; within each page a kind it lacks comes first. Needs kind, brand, rank, id, shown_from,
    shown_until. Brand leaders are cut to a bounded number per kind before the last, small steps."""
    live = pool.where((F.col("shown_from").isNull() | (F.col("shown_from") <= now))
                      & (F.col("shown_until").isNull() | (F.col("shown_until") >= now)))
    order = F.struct((-F.col("rank")).alias("r"), F.col("brand").alias("b"), F.col("id").alias("i"))
    # A brand's best entry per kind, then the best of each kind: a brand is used once, so per_kind of a kind need at most
    # the entries of n other brands before them, and the fill needs n more.
    best = live.groupBy("kind", "brand").agg(F.min_by(F.struct("id", "rank"), order).alias("e")).select("kind", "brand", "e.*")
    top = best.withColumn("at", F.row_number().over(Window.partitionBy("kind").orderBy(order))).where(F.col("at") <= 3 * n)
    few = top.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "kind", "brand", "id", "rank"))).alias("all"))

    def take(source: Column, start: Column, capped: bool) -> Column:
        def step(acc: Column, d: Column) -> Column:
            full = F.size(acc) >= n
            used = F.exists(acc, lambda x: x["brand"] == d["brand"])
            many = F.size(F.filter(acc, lambda x: x["kind"] == d["kind"])) >= per_kind if capped else F.lit(False)
            return F.when(full | used | many, acc).otherwise(F.array_append(acc, d))
        return F.aggregate(source, start, step)

    empty = F.filter(F.col("all"), lambda d: F.lit(False))
    chosen = F.array_sort(take(F.col("all"), take(F.col("all"), empty, True), False))

    def mix(acc: Column, k: Column) -> Column:
        shown = F.slice(acc["out"], F.size(acc["out"]) - F.size(acc["out"]) % page + 1, page)
        fresh = F.filter(acc["left"], lambda d: ~F.exists(shown, lambda s: s["kind"] == d["kind"]))
        nxt = F.when(F.size(fresh) > 0, F.get(fresh, 0)).otherwise(F.get(acc["left"], 0))
        return F.struct(F.array_append(acc["out"], nxt).alias("out"),
                        F.filter(acc["left"], lambda d: d["id"] != nxt["id"]).alias("left"))

    mixed = few.select(chosen.alias("c")).select(F.aggregate(
        F.when(F.size("c") > 0, F.sequence(F.lit(1), F.size("c"))).otherwise(F.array().cast("array<int>")),
        F.struct(F.filter("c", lambda d: F.lit(False)).alias("out"), F.col("c").alias("left")), mix)["out"].alias("out"))
    return mixed.select(F.posexplode("out").alias("pos", "d")).select((F.col("pos") + 1).alias("place"), "d.kind", "d.brand",
                                                                        "d.id", "d.rank")
