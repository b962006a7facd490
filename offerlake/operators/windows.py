"""Rankings within groups. A group may hold a third of all rows: rankings are bounded by `row_number <= n`, which Spark
applies before the shuffle too, and a best row is an aggregate, never a window over the whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fn_norm


def best_of(df: DataFrame, by: Sequence[str], order: Column, count: str | None = None) -> DataFrame:
    """One row per key, the first by `order`; with `count`, how many there were."""
    rest = [c for c in df.columns if c not in by]
    aggs = [F.min_by(F.struct(*rest), order).alias("_b")] + ([F.count("*").alias(count)] if count else [])
    return df.groupBy(*by).agg(*aggs).select(*by, "_b.*", *([count] if count else []))


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def shuffled(seed: int, *ids: str) -> Column:
    """A fixed random order: the same rows and seed give the same order on any cluster."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *ids))


def win_topn_capped(deals: DataFrame, n: int = 25, cap: int = 5) -> DataFrame:
    """Per category the n best deals, at most `cap` of one seller. Needs category, seller, score, pct, title, id."""
    order = [F.col("score").desc(), F.col("pct").desc(), F.col("title").asc(), F.col("id").asc()]
    few = top_n(deals, ["category", "seller"], order, cap, "_of_seller").drop("_of_seller")
    return top_n(few, ["category"], order, n)


def win_longest_duplicate(deals: DataFrame, key: Sequence[str]) -> DataFrame:
    """The same item at the same price in several ads: the copy that ends last, of equals the first; and how many."""
    order = F.struct((-F.unix_micros("valid_to")).alias("e"), F.col("ord").alias("o"), F.col("id").alias("i"))
    return best_of(deals, key, order, "copies")


def win_lowest_price_duplicate(deals: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The same product from several posts: the lowest price leads and carries all their categories; the others are linked
    to it in a table of their own, (id, lead). Needs price, id, categories."""
    lead = best_of(deals, [key], F.struct("price", "id"), "posts")
    cats = (deals.select(key, F.explode("categories").alias("c")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("categories")))
    kept = lead.drop("categories").join(cats, key, "left")
    links = (deals.join(lead.where("posts > 1").select(key, F.col("id").alias("lead")), key)
             .where(F.col("id") != F.col("lead")).select("id", "lead"))
    return kept, links


def win_best_per_site(items: DataFrame, n: int = 12) -> DataFrame:
    """Per site its n best products, one per title. Needs site, title, score, savings, id."""
    order = F.struct((-F.col("score")).alias("s"), (-F.coalesce("savings", F.lit(0.0))).alias("v"), F.col("title").alias("t"), F.col("id").alias("i"))
    one = best_of(items.withColumn("_t", fn_norm(F.col("title"))), ["site", "_t"], order).drop("_t")
    return top_n(one, ["site"], [F.col("score").desc(), F.coalesce("savings", F.lit(0.0)).desc(), F.col("title").asc(), F.col("id").asc()], n)


def win_detail_lead(deals: DataFrame, n: int = 24, group: Sequence[str] = ("area", "radius")) -> DataFrame:
    """The n leaders of each category in each search: whose full records are read first. Needs categories and the order's
    columns; a deal in several leads appears once per lead."""
    d = deals.withColumn("category", F.explode("categories"))
    return top_n(d, [*group, "category"], [F.col("score").desc(), F.coalesce("savings", F.lit(0.0)).desc(), F.col("title").asc(), F.col("id").asc()], n)


def win_best_per_store(deals: DataFrame) -> DataFrame:
    return best_of(deals.where("score > 0"), ["store"], F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")))


def win_kind_pool(items: DataFrame, n: int = 12) -> DataFrame:
    """Per kind the n best, one per brand. Needs kind, brand, rank, id."""
    one = best_of(items.where("rank > 0"), ["kind", "brand"], F.struct((-F.col("rank")).alias("r"), F.col("id").alias("i")))
    return top_n(one, ["kind"], [F.col("rank").desc(), F.col("brand").asc(), F.col("id").asc()], n)


def win_latest_reads(reads: DataFrame, n: int = 5) -> DataFrame:
    return top_n(reads, ["key"], [F.col("checked_at").desc(), F.col("id").desc()], n)


def win_order_check(rows: DataFrame) -> DataFrame:
    """Rows of a list that score above the row before them. Needs list, pos, score. Neighbours meet by position, so a long
    list is spread over the cluster instead of walked in one task."""
    before = rows.select("list", (F.col("pos") + 1).alias("pos"), F.col("score").alias("before"))
    return rows.join(before, ["list", "pos"]).where(F.col("score") > F.col("before"))


def win_round_robin_sample(df: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """n rows spread over the groups: one of each in turn, each group in a random order. A group can give n at most."""
    few = top_n(df, [group], [shuffled(seed, "id"), F.col("id")], n, "turn")
    return few.orderBy("turn", group).limit(n)


def win_stratified_cities(areas: DataFrame, large: int, mid: int, seed: int, n: tuple[int, int, int] = (3, 3, 4)) -> DataFrame:
    """Some large, some middling and some small areas at random."""
    pop = F.coalesce("population", F.lit(0))
    s = areas.withColumn("stratum", F.when(pop >= large, "large").when(pop >= mid, "mid").otherwise("small"))
    want = F.when(F.col("stratum") == "large", n[0]).when(F.col("stratum") == "mid", n[1]).otherwise(n[2])
    return top_n(s, ["stratum"], [shuffled(seed, "id"), F.col("id")], max(n)).where(F.col("place") <= want)


def win_quota_replace(verdicts: DataFrame, quota: int) -> DataFrame:
    """Per category, subjects in order until `quota` of them were conclusive. The last one taken is the quota-th conclusive
    subject, found as a bounded ranking; no running sum over the category is needed. Needs category, pos, verdict."""
    last = (top_n(verdicts.where("verdict <> 'inconclusive'"), ["category"], [F.col("pos").asc()], quota)
            .groupBy("category").agg(F.max("pos").alias("_last"), F.count("*").alias("_n")).where(F.col("_n") >= quota))
    return verdicts.join(last, "category", "left").where(F.col("_last").isNull() | (F.col("pos") <= F.col("_last"))).drop("_last", "_n")


def win_weighted_sample(areas: DataFrame, n: int, seed: int, least: int = 500) -> DataFrame:
    """n distinct areas drawn with their population as weight: the n smallest of -ln(u) / weight."""
    u = (F.conv(F.substring(shuffled(seed, "id"), 1, 12), 16, 10).cast("double") + 1) / float(16 ** 12 + 1)
    key = -F.log(u) / F.greatest(F.coalesce("population", F.lit(0)), F.lit(least))
    return areas.withColumn("_k", key).orderBy("_k", "id").limit(n).drop("_k")
