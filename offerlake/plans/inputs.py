"""The driver's tables read as offers, posts, places, reads and pages.

Each input is stated twice, as a DataFrame and as the SQL the oracles use; both are the same expression."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fn_pct, sc_local
from ..functions.amounts import rounded
from ..session import stated_parts, tune


class Tables:
    """One scale factor's tables and the inputs built from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df

    @cached_property
    def deals(self) -> DataFrame:
        """Every line as an item on sale: a part at a supplier, its discount, its terms and its days."""
        line = self.read("lineitem")
        part = self.read("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        d = (line.join(part, line.l_partkey == part.p_partkey)
             .select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
                     F.col("l_orderkey").alias("ad"), F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("merchant"),
                     F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
                     F.col("p_size").alias("size"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"),
                     F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
                     rounded(unit * (1 - F.col("l_discount")), 2).alias("price"), rounded(unit, 2).alias("regular"),
                     F.col("l_shipdate").alias("valid_from"),
                     (F.col("l_shipdate") + F.make_dt_interval(F.col("l_linenumber") + 6)).alias("valid_to")))
        d = d.withColumns({
            "pct": fn_pct(F.col("price"), F.col("regular")),
            "savings": rounded(F.col("regular") - F.col("price"), 2),
            "hedge": F.when((F.col("status") == "F") & (F.col("line") == 1), F.lit("up to")).otherwise(F.lit("")),
            "conditions": F.slice(F.array(F.lit("limit"), F.lit("in store only"), F.lit("coupon required")),
                                  1, F.col("line") % 4),
        })
        return d.withColumn("basis", F.when(F.col("pct").isNull(), "none").when(F.col("flag") == "A", "store_regular")
                            .when(F.col("flag") == "N", "claimed_savings").otherwise("list"))

    @property
    def parts(self) -> int:
        """In how many parts rows with much work each are dealt out."""
        return stated_parts(self.spark)

    @cached_property
    def spread_deals(self) -> DataFrame:
        """The deals for jobs that spend their time on each row, dealt out by id: how the files are cut says nothing about the work, nor do
        the bytes of a row, by which AQE would bring millions of rows into one task; so the number of parts is stated."""
        return self.deals.repartition(self.parts, "id")

    @cached_property
    def scored(self) -> DataFrame:
        return self.deals.withColumn("score", sc_local(F.col("pct"), F.col("basis"), F.col("hedge"), F.col("conditions")))

    @cached_property
    def posts(self) -> DataFrame:
        """Every event as a deal post: its source, its seller, its price and, for some, an expiry."""
        k = F.get_json_object("props", "$.k").cast("int")
        return (self.read("events")
                .select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.col("user_id").alias("seller"),
                        F.col("ts").alias("posted_at"), F.col("value").alias("price"), k.alias("k"))
                .withColumn("expires_at", F.when(F.col("k") % 3 != 0, F.col("posted_at") + F.make_dt_interval(hours=F.col("k"))))
                .withColumn("expires_stated", F.col("k") % 2 == 0))

    @cached_property
    def cities(self) -> DataFrame:
        c = self.read("customer")
        return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
                        *_point("c_custkey"), F.floor(F.abs("c_acctbal") * 100).cast("bigint").alias("population"),
                        F.col("c_mktsegment").alias("segment"))

    @cached_property
    def places(self) -> DataFrame:
        s = self.read("supplier")
        return s.select(F.col("s_nationkey").alias("chain"), *_point("s_suppkey"),
                        F.concat(F.lit("s"), "s_suppkey").alias("ref"), F.col("s_name").alias("name"),
                        F.col("s_suppkey").alias("merchant"))

    @cached_property
    def reads(self) -> DataFrame:
        """Every event as one read of an evidence page; a third of them could not be read."""
        p = self.posts
        return p.select(F.col("seller").alias("key"), F.col("posted_at").alias("checked_at"),
                        F.when(F.col("k") % 3 != 0, F.col("k") % 2 == 0).alias("found"), F.col("source").alias("kind"),
                        F.col("id"))

    @cached_property
    def price_points(self) -> DataFrame:
        line = self.read("lineitem")
        return line.select(F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("site"),
                           rounded(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"),
                           F.col("l_shipdate").alias("observed_at"), F.col("l_orderkey").alias("deal"),
                           F.col("l_linenumber").alias("line"))

    @cached_property
    def verdicts(self) -> DataFrame:
        c = self.read("conversations")
        return c.select((F.col("conv_id") % 5).cast("bigint").alias("run"), F.concat_ws("-", "conv_id", "turn").alias("test"),
                        F.col("role").alias("category"), F.length("text").cast("bigint").alias("length"),
                        F.when(F.length("text") % 7 == 0, "inconclusive").when(F.length("text") % 11 == 0, "pending")
                        .when(F.col("turn") % 2 == 0, "pass").otherwise("fail").alias("verdict"))

    @cached_property
    def examples(self) -> DataFrame:
        """Labelled documents: the words of the text, and the labels one of them carries."""
        docs = self.read("documents").select("doc_id", "text", "source")
        return (docs.join(self.read("labels"), "doc_id")
                .select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("words"),
                        F.when(F.col("toxic") == 1, F.array(F.concat(F.lit("q"), "quality"), F.lit("toxic")))
                        .otherwise(F.array(F.concat(F.lit("q"), "quality"))).alias("labels")))


def _point(key: str) -> list:
    k = F.col(key)
    return [(26 + (k * 7919 % 10000) / 1000.0).alias("lat"), (-106 + (k * 104729 % 12000) / 1000.0).alias("lon")]


WEIGHT = ("CASE {b} WHEN 'market' THEN 1.0 WHEN 'store_regular' THEN 0.9 WHEN 'editor_compare' THEN 0.8 WHEN 'claimed_savings' "
          "THEN 0.6 WHEN 'history' THEN 0.6 WHEN 'list' THEN 0.5 ELSE 0.0 END::DOUBLE")

HAVERSINE = ("2 * 3958.8 * asin(least(1.0, sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * "
             "cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))")

SQL = {
    "deals": f"""
        SELECT *, CASE WHEN pct IS NULL THEN 'none' WHEN flag = 'A' THEN 'store_regular' WHEN flag = 'N' THEN 'claimed_savings'
                       ELSE 'list' END AS basis
        FROM (SELECT *, CASE WHEN price < regular THEN floor((1 - price / regular) * 100 * 10 + 0.5) / 10 END AS pct,
                     floor((regular - price) * 100 + 0.5) / 100 AS savings,
                     CASE WHEN status = 'F' AND line = 1 THEN 'up to' ELSE '' END AS hedge,
                     list_slice(['limit', 'in store only', 'coupon required'], 1, line % 4) AS conditions
              FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey AS ad,
                           l_partkey AS item, l_suppkey AS merchant, p_name AS title, p_brand AS brand, p_type AS category,
                           p_size AS size, l_linenumber AS line, l_quantity AS quantity, l_returnflag AS flag,
                           l_linestatus AS status,
                           floor(l_extendedprice / l_quantity * (1 - l_discount) * 100 + 0.5) / 100 AS price,
                           floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS regular, l_shipdate AS valid_from,
                           l_shipdate + to_days(l_linenumber + 6) AS valid_to
                    FROM lineitem JOIN part ON l_partkey = p_partkey))""",
    "scored": """
        SELECT *, floor((coalesce(pct, 0.0::DOUBLE) * (CASE basis WHEN 'store_regular' THEN 0.9 WHEN 'claimed_savings' THEN 0.6
                  WHEN 'list' THEN 0.5 ELSE 0.0 END)::DOUBLE * (CASE WHEN hedge <> '' THEN 0.5 ELSE 1.0 END)::DOUBLE
                  * greatest(1 - 0.1::DOUBLE * len(list_filter(conditions, lambda c: c <> 'in store only')), 0.5::DOUBLE)) * 100 + 0.5) / 100 AS score
        FROM deals""",
    "posts": """
        SELECT *, CASE WHEN k % 3 <> 0 THEN posted_at + to_hours(k) END AS expires_at, k % 2 = 0 AS expires_stated
        FROM (SELECT event_id AS id, event_type AS source, user_id AS seller, ts AS posted_at, value AS price,
                     CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "cities": """
        SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, 26 + (c_custkey * 7919 % 10000) / 1000.0::DOUBLE AS lat,
               -106 + (c_custkey * 104729 % 12000) / 1000.0::DOUBLE AS lon,
               CAST(floor(abs(c_acctbal) * 100) AS BIGINT) AS population, c_mktsegment AS segment FROM customer""",
    "places": """
        SELECT s_nationkey AS chain, 26 + (s_suppkey * 7919 % 10000) / 1000.0::DOUBLE AS lat,
               -106 + (s_suppkey * 104729 % 12000) / 1000.0::DOUBLE AS lon, 's' || s_suppkey AS ref, s_name AS name,
               s_suppkey AS merchant FROM supplier""",
    "reads": """
        SELECT seller AS key, posted_at AS checked_at, CASE WHEN k % 3 <> 0 THEN k % 2 = 0 END AS found, source AS kind, id
        FROM posts""",
    "price_points": """
        SELECT l_partkey AS product, l_suppkey AS site, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price,
               l_shipdate AS observed_at, l_orderkey AS deal, l_linenumber AS line FROM lineitem""",
    "verdicts": """
        SELECT conv_id % 5 AS run, conv_id || '-' || turn AS test, role AS category, length(text) AS length,
               CASE WHEN length(text) % 7 = 0 THEN 'inconclusive' WHEN length(text) % 11 = 0 THEN 'pending'
                    WHEN turn % 2 = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM conversations""",
    "examples": """
        SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS words,
               CASE WHEN toxic = 1 THEN ['q' || quality, 'toxic'] ELSE ['q' || quality] END AS labels
        FROM documents JOIN labels USING (doc_id)""",
}
NEEDS = {"scored": ["deals"], "reads": ["posts"]}


def rnd(expr: str, places: int = 2) -> str:
    """`rounded` in SQL."""
    return f"(floor(({expr}) * {10 ** places} + 0.5) / {10 ** places})"


def miles_sql(a: str, b: str) -> str:
    return HAVERSINE.format(lat1=f"{a}.lat", lon1=f"{a}.lon", lat2=f"{b}.lat", lon2=f"{b}.lon")


def using(*names: str, body: str, **more: str) -> str:
    """The oracle SQL: the named inputs as CTEs, then any further ones, then the body."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)
    for n in names:
        add(n)
    ctes = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({s})" for n, s in more.items()]
    if not ctes:
        return body
    start = body.lstrip()
    # a body with CTEs of its own goes on with the list
    join = ",\n" + start[4:] if start.startswith("WITH") else "\n" + body
    return "WITH RECURSIVE " + ",\n".join(ctes) + join
