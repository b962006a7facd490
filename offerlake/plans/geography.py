"""Queries of the joins by distance and of coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fn_haversine
from ..functions.geo import cos_lat
from ..operators import geojoins as ops
from ..operators.aggregates import agg_ad_overlap_by_distance, agg_merchant_table, agg_place_dedupe, agg_points_union
from ..functions.amounts import rounded
from .catalog import query
from .inputs import Tables, miles_sql, rnd, using

TENTH = rnd(miles_sql("c", "p"), 1)


@query("fn_haversine", using("cities", "places", body=f"""
    SELECT count(*) AS n, floor(sum(mi) / 1000) AS thousands, {rnd('max(mi)')} AS most FROM (
      SELECT {miles_sql('c', 'p')} AS mi FROM cities c JOIN places p ON c.nation = p.chain)"""))
def _(t: Tables):
    p = t.places.select("chain", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), cos_lat(F.col("lat")).alias("cos2"))
    # a city meets all places of its nation: a file of few bytes is much work, so the cities are dealt out in a stated number of parts
    cities = t.cities.select("id", "nation", "lat", "lon").repartition(t.parts, "id").withColumn("cos1", cos_lat(F.col("lat")))
    pairs = cities.join(p, cities.nation == p.chain)
    mi = fn_haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"), F.col("cos1"), F.col("cos2"))
    return pairs.select(mi.alias("mi")).agg(F.count("*").alias("n"), F.floor(F.sum("mi") / 1000).cast("double").alias("thousands"),
                                            rounded(F.max("mi"), 2).alias("most"))


NEAREST = f"""
    SELECT area, chain, ref, distance_mi FROM (
      SELECT c.id AS area, p.chain, p.ref, {TENTH} AS distance_mi,
             row_number() OVER (PARTITION BY c.id, p.chain ORDER BY {miles_sql('c', 'p')}, p.ref) AS r
      FROM cities c JOIN places p ON abs(c.lat - p.lat) < 0.8) WHERE r = 1 AND distance_mi <= 50"""


@query("jn_nearest_place", using("cities", "places", body=NEAREST))
def _(t: Tables):
    return ops.jn_nearest_place(t.cities, t.places, 50.0, 12.0)


@query("jn_store_status", using("cities", "places", nearest=NEAREST, body="""
    SELECT status AS store_status, reason, count(*) AS n, CAST(sum(area) AS BIGINT) AS checksum FROM (
      SELECT d.area, CASE WHEN distance_mi <= 25 THEN 'nearby' WHEN distance_mi IS NOT NULL THEN 'far' WHEN d.merchant % 4 = 0 OR
                     d.merchant % 5 = 0 THEN 'unmapped' ELSE 'far' END AS status,
             CASE WHEN distance_mi > 25 THEN 'nearest store beyond 25 mi' WHEN distance_mi IS NULL AND NOT (d.merchant % 4 = 0 OR
                  d.merchant % 5 = 0) THEN 'no store within 50 mi' END AS reason
      FROM (SELECT id AS area, nation AS merchant FROM cities) d LEFT JOIN nearest n ON n.area = d.area AND n.chain = d.merchant)
    GROUP BY ALL"""))
def _(t: Tables):
    near = ops.jn_nearest_place(t.cities, t.places, 50.0, 12.0)
    deals = t.cities.select(F.col("id").alias("area"), F.col("nation").alias("merchant"))
    merchants = t.read("nation").select(F.col("n_nationkey").alias("merchant"), F.when(F.col("n_nationkey") % 4 == 0, "sparse").alias("coverage"),
                                        (F.col("n_nationkey") % 5 != 0).alias("known"))
    return (ops.jn_store_status(deals, near, merchants, 25.0).groupBy("store_status", "reason")
            .agg(F.count("*").alias("n"), F.sum("area").cast("bigint").alias("checksum")))


@query("jn_radius_semi", using("cities", "places", body=f"""
    SELECT site, name FROM (SELECT n_nationkey AS site, n_name AS name FROM nation) WHERE site IN (
      SELECT p.chain FROM places p JOIN (SELECT * FROM cities WHERE population > 900000) c ON {miles_sql('c', 'p')} <= 5)"""))
def _(t: Tables):
    sites = t.read("nation").select(F.col("n_nationkey").alias("site"), F.col("n_name").alias("name"))
    return ops.jn_radius_semi(sites, t.places.withColumnRenamed("chain", "site"), t.cities.where("population > 900000"), 5.0).select("site", "name")


@query("jn_unlisted_anti", using("cities", "places", body=f"""
    WITH used AS (SELECT chain FROM (SELECT chain, count(*) AS m FROM places GROUP BY chain) JOIN
                  (SELECT nation, count(*) AS l FROM cities GROUP BY nation) ON chain = nation WHERE l >= 14.0 * m)
    SELECT ref, chain FROM places p WHERE chain IN (SELECT chain FROM used) AND NOT EXISTS (
      SELECT 1 FROM cities c WHERE c.nation = p.chain AND {miles_sql('c', 'p')} <= 40)"""))
def _(t: Tables):
    listed = t.cities.select(F.col("nation").alias("chain"), "lat", "lon")
    return ops.jn_unlisted_anti(t.places, listed, 40.0, 14.0).select("ref", "chain")


@query("jn_city_anchor", using("cities", body=f"""
    SELECT id, anchor, anchor_mi FROM (
      SELECT c.id, p.id AS anchor, {TENTH} AS anchor_mi, row_number() OVER (PARTITION BY c.id ORDER BY {miles_sql('c', 'p')}, p.id) AS r
      FROM cities c, (SELECT * FROM cities WHERE population > 960000) p) WHERE r = 1"""))
def _(t: Tables):
    return ops.jn_city_anchor(t.cities, t.cities.where("population > 960000"), 60.0).select("id", "anchor", "anchor_mi")


@query("jn_area_limit", using("cities", "places", body=f"""
    SELECT area, offer, ref, distance_mi FROM (
      SELECT c.id AS area, o.offer, p.ref, {TENTH} AS distance_mi,
             row_number() OVER (PARTITION BY c.id, o.offer ORDER BY {miles_sql('c', 'p')}, p.ref) AS r
      FROM (SELECT n_nationkey AS offer, n_nationkey AS chain, 31.0::DOUBLE AS lat, -100.0::DOUBLE AS lon FROM nation) o
      JOIN places p ON p.chain = o.chain AND (o.offer % 3 = 0 OR {miles_sql('o', 'p')} <= 200)
      JOIN cities c ON abs(c.lat - p.lat) < 0.8) WHERE r = 1 AND distance_mi <= 50"""))
def _(t: Tables):
    offers = t.read("nation").select(F.col("n_nationkey").alias("offer"), F.col("n_nationkey").alias("chain"), F.lit(31.0).alias("lat"),
                                     F.lit(-100.0).alias("lon"), F.when(F.col("n_nationkey") % 3 != 0, 200.0).alias("mi"))
    return ops.jn_area_limit(offers, t.places, t.cities)


@query("agg_footprint", using("places", body=f"""
    SELECT chain, branches, {rnd('s', 1)} AS spread_mi, branches >= 3 AND s >= 500 AS statewide FROM (
      SELECT c.chain, c.branches, {miles_sql('c', 'p')} AS s FROM (SELECT chain, count(*) AS branches, min(lat) AS lat, min(lon) AS lon
        FROM places GROUP BY chain) c JOIN (SELECT chain, max(lat) AS lat, max(lon) AS lon FROM places GROUP BY chain) p USING (chain))"""))
def _(t: Tables):
    return ops.agg_footprint(t.places, 3, 500.0)


@query("agg_place_dedupe", using("cities", body="""
    SELECT chain, count(*) AS n, min(ref) AS first FROM (SELECT nation AS chain, min('c' || id) AS ref FROM cities
      GROUP BY nation, round_even(lat * 2, 0), round_even(lon * 2, 0)) GROUP BY chain"""))
def _(t: Tables):
    p = t.cities.select(F.col("nation").alias("chain"), "lat", "lon", F.concat(F.lit("c"), "id").alias("ref"))
    return agg_place_dedupe(p, 2).groupBy("chain").agg(F.count("*").alias("n"), F.min("ref").alias("first"))


@query("agg_points_union", using("cities", body="""
    WITH pts AS (SELECT nation AS chain, id % 9 AS run, lat, lon, id AS ref FROM cities WHERE (id % 9 + nation) % 4 <> 0),
    ranked AS (SELECT *, dense_rank() OVER (PARTITION BY chain ORDER BY run DESC) AS r FROM pts WHERE run >= 3)
    SELECT chain, run, count(*) AS n, CAST(sum(ref) AS BIGINT) AS checksum FROM (
      SELECT *, row_number() OVER (PARTITION BY chain, round_even(lat, 0), round_even(lon, 0) ORDER BY r, ref) AS k FROM ranked WHERE r <= 3)
    WHERE k = 1 GROUP BY chain, run"""))
def _(t: Tables):
    pts = t.cities.where("(id % 9 + nation) % 4 <> 0").select(F.col("nation").alias("chain"), (F.col("id") % 9).alias("run"), "lat", "lon",
                                                               F.col("id").alias("ref"))
    return agg_points_union(pts, 3, 6, 1).groupBy("chain", "run").agg(F.count("*").alias("n"), F.sum("ref").alias("checksum"))


@query("agg_merchant_table", using("cities", "places", nearest=NEAREST, body="""
    SELECT a.area, a.merchant, 1::BIGINT AS ads, distance_mi, CASE WHEN distance_mi <= 25 THEN 'nearby' WHEN distance_mi IS NOT NULL THEN 'far'
      WHEN a.merchant IN (SELECT chain FROM places) THEN 'far' ELSE 'unmapped' END AS status FROM (SELECT id AS area, CASE WHEN id % 9 = 0 THEN 99 ELSE nation END AS merchant FROM cities) a
    LEFT JOIN nearest n ON n.area = a.area AND n.chain = a.merchant"""))
def _(t: Tables):
    near = ops.jn_nearest_place(t.cities, t.places, 50.0, 12.0)
    ads = t.cities.select(F.col("id").alias("area"), F.when(F.col("id") % 9 == 0, 99).otherwise(F.col("nation")).alias("merchant"))
    return agg_merchant_table(ads, near, 25.0, t.places.select(F.col("chain").alias("merchant")).distinct())


@query("agg_ad_overlap_by_distance", using("cities", body=f"""
    WITH shown AS (SELECT DISTINCT id AS area, o_orderkey % 40 AS ad FROM cities JOIN orders ON o_custkey = id),
    sets AS (SELECT area, list_sort(list(ad)) AS ads FROM shown GROUP BY area),
    nodes AS (SELECT c.id, c.lat, c.lon, s.ads FROM cities c JOIN sets s ON s.area = c.id)
    SELECT CAST(floor(mi / 10) AS BIGINT) AS bin, count(*) AS pairs, floor(avg(share) * 10000 + 0.5) / 10000 AS share FROM (
      SELECT {miles_sql('a', 'b')} AS mi, len(list_intersect(a.ads, b.ads)) / len(list_distinct(list_concat(a.ads, b.ads)))::DOUBLE AS share
      FROM nodes a JOIN nodes b ON a.id < b.id AND abs(a.lat - b.lat) < 0.6) WHERE mi < 40 GROUP BY 1"""))
def _(t: Tables):
    at = t.read("orders").select(F.col("o_custkey").alias("area"), (F.col("o_orderkey") % 40).alias("ad")).distinct()
    return agg_ad_overlap_by_distance(at, t.cities)


@query("cov_anchors", using("cities", body=f"""
    WITH ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY population DESC, id) AS k FROM cities),
    pairs AS MATERIALIZED (SELECT a.k AS hi, b.k AS lo FROM ranked a JOIN ranked b ON a.k < b.k AND abs(a.lat - b.lat) < 0.6
              AND {miles_sql('a', 'b')} <= 40),
    everyone AS MATERIALIZED (SELECT list((SELECT CASE WHEN r.population >= 990000 THEN [] ELSE coalesce(list(hi), []) END FROM pairs WHERE lo = r.k) ORDER BY k) AS his
                 FROM ranked r),
    walk(k, chosen, his) AS (
      SELECT 0::BIGINT, []::BIGINT[], his FROM everyone
      UNION ALL
      SELECT k + 1, CASE WHEN list_has_any(chosen, his[k + 1]) THEN chosen ELSE list_append(chosen, k + 1) END, his FROM walk WHERE k < len(his))
    SELECT r.id, r.population FROM ranked r WHERE r.k IN (SELECT unnest(chosen) FROM (SELECT chosen FROM walk ORDER BY k DESC LIMIT 1))"""))
def _(t: Tables):
    return ops.cov_anchors(t.cities, 40.0, 990_000).select("id", "population")
