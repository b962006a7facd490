"""URL filters by a Bloom filter cascade.

A listed key is a host and the start of a path (`example.org/es/`). The key universe is every key the corpus can ask for: for each
url, its host's suffixes with the starts of its path, in the shapes (labels of the host, length of the path) that occur in the list.
Level 1 encodes the listed keys, level 2 the unlisted keys of the universe that level 1 lets through, level 3 the listed keys that
level 2 lets through, and so on until nothing comes through; a key is then listed if the number of levels it passes is odd. So
membership is exact for all of the universe, and asking needs a few bits a listed key and no join.

Defined results: a null url or one without `://` has an empty host and path and no rule; a host keeps user and port as written; of
fitting rules the longest key wins, of keys of one length the one with the longer host; repeated list rows count once, and a key listed as both allow and block blocks; an empty list
allows everything; extra columns of either table are left out of the work and other columns of `urls` are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from offerlake.session import cut

from .catalog import query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    rest = F.expr("substring(_u, locate('://', _u) + 3)")
    return F.when(F.locate("://", url) > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def url_path(url: Column) -> Column:
    rest = F.expr("substring(_u, locate('://', _u) + 3)")
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """`urls` with `host` and `path`; columns of those names are replaced."""
    u = F.col("_u")
    return urls.withColumn("_u", F.col(url)).withColumns({"host": url_host(u), "path": url_path(u)}).drop("_u")


# ---- the filters -------------------------------------------------------------------------------------------------------------------

def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64, a public finaliser: spreads the bits of a hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bit_places(h: np.ndarray, level: int, hashes: int, bits: int) -> np.ndarray:
    """One row of bit numbers for each hashed key; every level deals anew."""
    h = h.astype(np.int64).view(np.uint64)
    a = mixed(h + np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) % 2**64))
    b = mixed(h ^ np.uint64(0xD1B54A32D192ED03 * (2 * level + 2) % 2**64)) | np.uint64(1)
    i = np.arange(hashes, dtype=np.uint64)
    return ((a[:, None] + i * b[:, None]) % np.uint64(bits)).astype(np.int64)


def passes(h: np.ndarray, level: int, filt: dict) -> np.ndarray:
    at = bit_places(h, level, filt["hashes"], filt["bits"])
    return ((filt["words"][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def listed(h: np.ndarray, cascade: list[dict]) -> np.ndarray:
    """Whether keys with these hashes are listed: the number of levels a key passes is odd."""
    depth, alive = np.zeros(len(h), dtype=np.int64), np.arange(len(h))
    for level, filt in enumerate(cascade):
        if not len(alive):
            break
        alive = alive[passes(h[alive], level, filt)]
        depth[alive] = level + 1
    return depth % 2 == 1


def filter_shape(keys: int, rate: float) -> tuple[int, int]:
    """(hash functions, bits) of a filter for so many keys and this rate of false positives."""
    hashes = max(1, round(math.log2(1 / rate))) if keys else 1
    return hashes, max(64, 64 * math.ceil(keys * hashes / math.log(2) / 64))


def build_filter(hashed: DataFrame, level: int, keys: int, rate: float) -> dict:
    """The filter's words: every task sets bits in a sparse block of its own, blocks meet by bitwise or. The driver gets the filter
    itself only, whose size the caller has checked."""
    hashes, bits = filter_shape(keys, rate)

    def words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            at = bit_places(part["h"].to_numpy(), level, hashes, bits).ravel()
            idx, inv = np.unique(at >> 6, return_inverse=True)
            out = np.zeros(len(idx), dtype=np.uint64)
            np.bitwise_or.at(out, inv, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pd.DataFrame({"word": idx, "bits": out.view(np.int64)})

    got = hashed.select("h").mapInPandas(words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    full = np.zeros(bits // 64, dtype=np.uint64)
    full[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return {"hashes": hashes, "bits": bits, "words": full}


def build_cascade(spark: SparkSession, keys: DataFrame, universe: DataFrame, n_keys: int, n_universe: int) -> list[dict]:
    """The levels for the distinct `keys` over the distinct `universe` (column `key` each). One pass over the universe; what comes
    through level 1 is about as large as the list, later levels halve it."""
    hashed = lambda df: df.select("key", F.xxhash64("key").alias("h"))
    if not n_keys:
        return []

    def through(df: DataFrame, level: int, filt: dict) -> DataFrame:
        shared = spark.sparkContext.broadcast(filt)

        @pandas_udf("boolean")
        def hit(h: pd.Series) -> pd.Series:
            return pd.Series(passes(h.to_numpy(), level, shared.value))
        return df.where(hit("h"))

    rate = min(0.5, math.sqrt(0.5) * n_keys / max(1, n_universe))
    inside, levels = cut(hashed(keys)), []
    levels.append(build_filter(inside, 0, n_keys, rate))
    outside = cut(through(hashed(universe), 0, levels[0]).join(inside.select("key"), "key", "left_anti"))
    left = outside.count()
    while left:
        level = len(levels)
        levels.append(build_filter(outside, level, left, 0.5))
        inside, outside = outside, cut(through(inside, level, levels[-1]))
        left = outside.count()
    return levels


# ---- the operator ------------------------------------------------------------------------------------------------------------------

def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys a url can be listed under, one for each shape of the list that it reaches."""
    def key(labels: int, length: int) -> Column:
        suffix = F.substring_index(host, ".", -labels)
        fits = (F.length(host) - F.length(F.translate(host, ".", "")) >= labels - 1) & (F.length(path) >= length)
        return F.when(fits, F.concat(suffix, F.substring(path, 1, length)))
    return F.array_compact(F.array(*[key(*s) for s in shapes])) if shapes else F.array().cast("array<string>")


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """`urls` with `host`, `path`, `rule` (the longest fitting key or null) and `verdict`; rules are (host, path, action).

    The filters are sent to the executors only while their planned size is within `max_filter_bytes`; a longer list is met by an
    equi-join on the candidate keys, with the same rows as result."""
    spark = urls.sparkSession
    lists = cut(rules.where(F.col("host").isNotNull()).select(
        F.concat(F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))).alias("key"),
        F.size(F.split("host", r"\.")).alias("labels"), F.length(F.coalesce("path", F.lit(""))).alias("length"),
        (F.col("action") == "block").alias("block")).groupBy("key", "labels", "length").agg(F.max("block").alias("block")))
    shapes = sorted((r.labels, r.length) for r in lists.select("labels", "length").distinct().collect())
    parts = with_parts(urls).drop("rule", "verdict", "_keys").withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), shapes))
    n_keys = lists.count()
    universe = parts.select(F.explode("_keys").alias("key")).distinct()
    longest = lambda c: F.reduce(c, F.lit(None).cast("string"), lambda best, k: F.when(best.isNull() | (F.length(k) >= F.length(best)), k).otherwise(best))  # noqa: E731  shapes with more labels come later

    universe = cut(universe)
    n_universe = universe.count()
    planned = sum(filter_shape(n, min(0.5, math.sqrt(0.5) * n_keys / max(1, n_universe)) if i == 0 else 0.5)[1] for i, n in enumerate([n_keys, n_keys])) / 8
    if planned > max_filter_bytes:
        hits = universe.join(lists.select("key", "block", "labels"), "key")
        per_url = (parts.select("host", "path", "_keys").dropDuplicates(["host", "path"]).select("host", "path", F.explode("_keys").alias("key")).join(hits, "key")
                   .groupBy("host", "path").agg(F.max_by(F.struct("key", "block"), F.struct(F.length("key"), "labels")).alias("_hit")))
        out = parts.drop("_keys").join(per_url, ["host", "path"], "left")
        return out.withColumns({"rule": F.col("_hit.key"), "verdict": F.when(F.col("_hit.block"), "block").when(F.col("_hit.key").isNotNull(), "allow").otherwise(default)}).drop("_hit")

    blocked = lists.where("block").select("key")
    n_blocked = blocked.count()
    member = spark.sparkContext.broadcast(build_cascade(spark, lists.select("key"), universe, n_keys, n_universe))
    blocking = spark.sparkContext.broadcast(build_cascade(spark, blocked, lists.select("key"), n_blocked, n_keys))

    @pandas_udf("array<boolean>")
    def in_list(hashes: pd.Series) -> pd.Series:
        ends = np.cumsum([len(x) for x in hashes])
        flat = listed(np.concatenate([*hashes, np.empty(0, dtype=np.int64)]).astype(np.int64), member.value)
        return pd.Series(np.split(flat, ends[:-1]) if len(ends) else [])

    @pandas_udf("boolean")
    def blocks(h: pd.Series) -> pd.Series:
        return pd.Series(listed(h.to_numpy(), blocking.value))

    hits = parts.withColumn("_in", in_list(F.transform("_keys", lambda k: F.xxhash64(k))))
    found = hits.withColumn("rule", longest(F.filter("_keys", lambda k, i: F.get("_in", i))))
    return (found.withColumn("verdict", F.when(F.col("rule").isNull(), default).when(blocks(F.xxhash64("rule")), "block").otherwise("allow"))
            .drop("_keys", "_in"))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rhost, rpath, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM hp JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM hp LEFT JOIN fits USING (page_id)
"""


@query("op1_url_cascade", ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")
