"""Joins by distance. A radius becomes an equi-join on grid cells; the side that is only tested for existence is the one
copied to neighbouring cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import Grid, fn_haversine
from ..functions.amounts import rounded
from ..functions.geo import small_cell
from ..session import cut


def _mi(a: str = "", b: str = "_") -> Column:
    return fn_haversine(F.col(f"{a}lat"), F.col(f"{a}lon"), F.col(f"{b}lat"), F.col(f"{b}lon"))


def _spread(points: DataFrame, grid: Grid, *keep: str) -> DataFrame:
    """Points under other names, once per cell they can be reached from."""
    return points.select(*keep, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"),
                         F.explode(grid.around(F.col("lat"), F.col("lon"))).alias("_cell"))


def within(points: DataFrame, others: DataFrame, mi: float, on: tuple[str, ...] = (), how: str = "left_semi") -> DataFrame:
    """The points that have (`left_semi`) or lack (`left_anti`) another point within `mi`, equal on the `on` columns."""
    grid = Grid(mi)
    p = points.withColumn("_at", grid.cell(F.col("lat"), F.col("lon")))
    o = _spread(others.select(*on, "lat", "lon").distinct(), grid, *[F.col(k).alias(f"_{k}") for k in on])
    same = F.col("_at") == F.col("_cell")
    for k in on:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return p.join(o, same & (_mi() <= mi), how).drop("_at")


def jn_nearest_place(areas: DataFrame, places: DataFrame, max_mi: float = 50.0, first_mi: float = 8.0) -> DataFrame:
    """Each area's nearest place of each chain within `max_mi`: area, chain, ref, distance_mi (rounded to a tenth, as it is
    shown and compared). `areas` has id, lat, lon; `places` chain, lat, lon, ref.

    Areas and places at one point are one. A near pass settles the chains close by; only chains a point could still reach
    and has not settled go to the far pass, so dense places near an area never meet it in the wide cells."""
    points = areas.select("lat", "lon").distinct()
    spots = places.groupBy("chain", "lat", "lon").agg(F.min("ref").alias("ref"))

    def nearest(pairs: DataFrame, mi: float) -> DataFrame:
        return (pairs.withColumn("mi", _mi()).where(F.col("mi") <= mi).groupBy("lat", "lon", "chain")
                .agg(F.min(F.struct("mi", "ref")).alias("best")).select("lat", "lon", "chain", "best.ref", "best.mi"))

    def reach(mi: float) -> tuple[DataFrame, DataFrame]:
        grid = Grid(mi)
        p = points.select("lat", "lon", F.explode(grid.around(F.col("lat"), F.col("lon"))).alias("cell"))
        s = spots.select("chain", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "ref", grid.cell(F.col("lat"), F.col("lon")).alias("cell"))
        return p, s

    slack = 0.05                                  # a distance that rounds down to the bound still counts
    p, s = reach(first_mi)
    near = nearest(p.join(s, "cell"), first_mi)
    p, s = reach(max_mi + slack)
    open_ = p.join(s.select("cell", "chain").distinct(), "cell").join(near.select("lat", "lon", "chain"), ["lat", "lon", "chain"], "left_anti")
    far = nearest(open_.join(s, ["cell", "chain"]), max_mi + slack)
    found = near.unionByName(far).withColumn("distance_mi", rounded(F.col("mi"), 1)).where(F.col("distance_mi") <= max_mi)
    return areas.select(F.col("id").alias("area"), "lat", "lon").join(found, ["lat", "lon"]).select("area", "chain", "ref", "distance_mi")


def jn_store_status(deals: DataFrame, nearest: DataFrame, merchants: DataFrame, radius_mi: float) -> DataFrame:
    """nearby, far or unmapped. Needs deals(area, merchant), nearest(area, chain, distance_mi), merchants(merchant,
    coverage, known): a merchant the map covers thinly or not at all is flagged, not ruled out."""
    n = nearest.select("area", F.col("chain").alias("merchant"), "distance_mi", "ref")
    df = deals.join(n, ["area", "merchant"], "left").join(merchants.select("merchant", "coverage", "known"), "merchant", "left")
    near = F.col("distance_mi").isNotNull()
    unsure = F.coalesce(F.col("coverage") == "sparse", F.lit(False)) | ~F.coalesce(F.col("known"), F.lit(False))
    status = (F.when(near & (F.col("distance_mi") <= radius_mi), "nearby").when(near, "far")
              .when(unsure, "unmapped").otherwise("far"))
    reason = (F.when(near & (F.col("distance_mi") > radius_mi), f"nearest store beyond {radius_mi:g} mi")
              .when(~near & (status == "far"), "no store within 50 mi"))
    return df.withColumns({"store_status": status, "reason": reason}).drop("coverage", "known")


def jn_radius_semi(sites: DataFrame, shops: DataFrame, points: DataFrame, radius_mi: float) -> DataFrame:
    """Sites with any shop within the radius of any of the points. Needs site on both, lat, lon."""
    near = within(shops.select("site", "lat", "lon"), points, radius_mi).select("site").distinct()
    return sites.join(near, "site", "left_semi")


def jn_unlisted_anti(branches: DataFrame, listed: DataFrame, mi: float = 0.75, complete: float = 0.8) -> DataFrame:
    """Mapped branches their chain's own list has no point near. A chain whose list holds under `complete` of its mapped
    branches is left alone. Needs chain, lat, lon on both."""
    mapped = branches.groupBy("chain").agg(F.count("*").alias("_mapped"))
    counted = listed.groupBy("chain").agg(F.count("*").alias("_listed"))
    used = mapped.join(counted, "chain").where(F.col("_listed") >= complete * F.col("_mapped")).select("chain")
    return within(branches.join(used, "chain", "left_semi"), listed, mi, on=("chain",), how="left_anti")


def jn_city_anchor(areas: DataFrame, anchors: DataFrame, mi: float = 20.0, crowd: int = 16) -> DataFrame:
    """Each area's nearest anchor and its distance. Anchors cover their areas, so one pass at `mi` settles nearly all; what
    is left is tried at twice the distance until nothing is. Where a cell of that size holds more than `crowd` anchors the first pass is at a
    distance at which none does, so that an area meets a few anchors and not all of a crowded place."""
    spots = cut(anchors.groupBy("lat", "lon").agg(F.min("id").alias("anchor")))
    left = areas.select("lat", "lon").distinct()
    done: DataFrame | None = None
    while mi > 0.05:
        most = spots.groupBy(Grid(mi).cell(F.col("lat"), F.col("lon")).alias("cell")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if (most or 0) <= crowd:
            break
        mi /= 2
    while True:
        grid = Grid(mi)
        p = left.withColumn("_at", grid.cell(F.col("lat"), F.col("lon")))
        s = _spread(spots, grid, "anchor")
        got = (p.join(s, F.col("_at") == F.col("_cell")).withColumn("mi", _mi()).where(F.col("mi") <= mi).groupBy("lat", "lon")
               .agg(F.min(F.struct("mi", "anchor")).alias("b")).select("lat", "lon", "b.anchor", "b.mi"))
        got = cut(got)
        done = got if done is None else done.unionByName(got)
        left = cut(left.join(got.select("lat", "lon"), ["lat", "lon"], "left_anti"))
        mi *= 2
        if mi > 12500 or left.isEmpty():
            break
    return areas.join(done, ["lat", "lon"]).withColumn("anchor_mi", rounded(F.col("mi"), 1)).drop("mi")


def jn_area_limit(offers: DataFrame, places: DataFrame, areas: DataFrame, max_mi: float = 50.0) -> DataFrame:
    """The nearest place to each area of each offer, among the places inside the offer's own circle if it has one. Needs
    offers(offer, chain, lat, lon, mi) with nulls for no circle.

    A circle is the cells that cover it, in the grid of the next power of two of its radius, and meets its chain's places by (chain, cell);
    offers without a circle have their chain's answer, which is worked out once."""
    c = F.col
    radius = F.ceil(F.log2(F.greatest(c("mi"), F.lit(1.0)))).cast("int")
    circles = cut(offers.where("mi IS NOT NULL").withColumn("_r", radius))
    spots = None
    for r in sorted(x["_r"] for x in circles.select("_r").distinct().collect()):                 # radii on the globe have 15 at most
        grid = Grid(2.0 ** r)
        cover = circles.where(c("_r") == r).select("offer", "chain", c("lat").alias("_lat"), c("lon").alias("_lon"), c("mi").alias("_r_mi"), F.explode(grid.around(c("lat"), c("lon"))).alias("_cell"))
        there = places.select("chain", "lat", "lon", "ref", grid.cell(c("lat"), c("lon")).alias("_cell"))
        some = cover.join(there, ["chain", "_cell"]).where(_mi() <= c("_r_mi")).select(c("offer").alias("chain"), "lat", "lon", "ref")
        spots = some if spots is None else spots.unionByName(some)
    bare = offers.where("mi IS NULL").select("offer", "chain")
    free = jn_nearest_place(areas, places.join(bare.select("chain").distinct(), "chain", "left_semi"), max_mi).join(bare, "chain").select("area", "offer", "ref", "distance_mi")
    return free if spots is None else free.unionByName(jn_nearest_place(areas, spots, max_mi).withColumnRenamed("chain", "offer").select("area", "offer", "ref", "distance_mi"))


def agg_footprint(places: DataFrame, min_n: int = 5, min_mi: float = 150.0) -> DataFrame:
    """Branches per chain, the diagonal of the box they cover, and whether the chain counts as found everywhere."""
    box = places.groupBy("chain").agg(F.count("*").alias("branches"), F.min("lat").alias("lat"), F.min("lon").alias("lon"),
                                      F.max("lat").alias("_lat"), F.max("lon").alias("_lon"))
    return (box.withColumn("spread", _mi()).withColumn("statewide", (F.col("branches") >= min_n) & (F.col("spread") >= min_mi))
            .select("chain", "branches", rounded(F.col("spread"), 1).alias("spread_mi"), "statewide"))


def cov_anchors(areas: DataFrame, mi: float = 20.0, pop: int = 50_000) -> DataFrame:
    """All areas of `pop` people or more, then the largest area no anchor is within `mi` of, until all are covered.

    In rounds: an uncovered area that outranks every uncovered area within `mi` would be the next the one-by-one order
    takes there, so all such areas are anchors at once. Only the best of a cell no wider than `mi` can be one, which keeps
    the candidates, and so the pairs, linear in the areas however crowded a place is."""
    ranked = areas.select("id", "lat", "lon", F.struct((-F.coalesce("population", F.lit(0))).alias("p"), F.col("id").alias("i")).alias("rank"))
    chosen = ranked.where(F.col("rank.p") <= -pop)
    out = cut(chosen)
    left = cut(within(ranked.where(F.col("rank.p") > -pop), out, mi, how="left_anti"))
    grid = Grid(mi)
    while not left.isEmpty():
        best = left.groupBy(small_cell(F.col("lat"), F.col("lon"), mi).alias("c")).agg(F.min(F.struct("rank", "id", "lat", "lon")).alias("b"))
        cand = best.select("b.*")
        rivals = _spread(cand, grid, F.col("id").alias("_id"), F.col("rank").alias("_rank"))
        beaten = (left.withColumn("_at", grid.cell(F.col("lat"), F.col("lon")))
                  .join(rivals, (F.col("_at") == F.col("_cell")) & (F.col("rank") < F.col("_rank")) & (_mi() <= mi))
                  .select(F.col("_id").alias("id")).distinct())
        new = cut(cand.join(beaten, "id", "left_anti").select("id", "lat", "lon", "rank"))
        out = out.unionByName(new)
        left = cut(within(left, new, mi, how="left_anti"))
    return areas.join(out.select("id"), "id", "left_semi")
