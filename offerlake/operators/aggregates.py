"""Counts, shares and reports. Groups are pre-aggregated before they are shuffled; an array is only gathered where its
length is bounded by what it holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Grid, fn_basis_weight, fn_haversine, fn_host, fn_pct, fn_words  # noqa: F401
from ..functions.amounts import rounded
from ..functions.geo import cos_lat, square
from ..functions.scores import evidence_weight
from ..functions.wording import status_words
from ..session import cut, stated_parts

MOST_BITS = 1024                                         # sets over as many values in all are held as bits
CROWD = 2048                                             # a cell of more areas is dealt to several places


def agg_excluded(df: DataFrame, how: str = "sum") -> DataFrame:
    """Rows left out by reason, most common first. Several runs that read the same feeds (`run`) are merged by their
    largest count instead of the sum."""
    lost = df.where("reason IS NOT NULL")
    if how == "max":
        return (lost.groupBy("run", "reason").agg(F.count("*").alias("n")).groupBy("reason").agg(F.max("n").alias("n"))
                .orderBy(F.col("n").desc(), "reason"))
    return lost.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "reason")


def agg_left_out_samples(df: DataFrame, n: int = 4) -> DataFrame:
    """Per reason, how many distinct rows were left out and the first few of them. Needs reason, id, example."""
    lost = df.where("reason IS NOT NULL").groupBy("reason", "id").agg(F.min("example").alias("example"))
    counts = lost.groupBy("reason").agg(F.count("*").alias("n"))
    first = (lost.withColumn("at", F.row_number().over(Window.partitionBy("reason").orderBy("id"))).where(F.col("at") <= n)
             .groupBy("reason").agg(F.array_sort(F.collect_list(F.struct("at", "example"))).alias("s")))
    return counts.join(first, "reason").select("reason", "n", F.col("s.example").alias("samples"))


def agg_lexicon(examples: DataFrame, at_least: int = 8) -> DataFrame:
    """word, labels (a sorted set), n: in how many examples a word carried a set of labels, for words with enough examples
    in all. Needs words and labels arrays, one row per example."""
    pairs = (examples.select(F.array_sort(F.array_distinct("labels")).alias("labels"), F.explode(F.array_distinct("words")).alias("word"))
             .where(F.size("labels") > 0).groupBy("word", "labels").agg(F.count("*").alias("n")))
    # the window runs over a word's label sets, not over its examples
    return pairs.withColumn("total", F.sum("n").over(Window.partitionBy("word"))).where(F.col("total") >= at_least).drop("total")


def agg_lexicon_share(lexicon: DataFrame, share: float = 0.9, at_least: int = 8, allowed: Sequence[str] | None = None) -> DataFrame:
    """word, categories, total: what nearly all of a word's examples carry. `allowed` narrows the labels first, so a word
    of phones and fruit is one of phones where no fruit is sold."""
    lex = lexicon
    if allowed is not None:
        lex = lex.withColumn("labels", F.array_intersect("labels", F.array(*[F.lit(a) for a in allowed]))).where(F.size("labels") > 0)
    totals = lex.groupBy("word").agg(F.sum("n").alias("total")).where(F.col("total") >= at_least)
    carried = lex.select("word", "n", F.explode("labels").alias("category")).groupBy("word", "category").agg(F.sum("n").alias("n"))
    return (carried.join(totals, "word").where(F.col("n") >= share * F.col("total")).groupBy("word", "total")
            .agg(F.array_sort(F.collect_set("category")).alias("categories")))


def agg_lexicon_classify(texts: DataFrame, shares: DataFrame) -> DataFrame:
    """id, categories, rule: what a text's best-attested learned word says. Needs texts(id, words)."""
    best = (texts.select("id", F.explode("words").alias("word")).join(shares, "word").groupBy("id")
            .agg(F.max(F.struct("total", "word", "categories")).alias("b")))
    return best.select("id", "b.categories", F.concat(F.lit("learned:"), "b.word", F.lit(" ("), F.col("b.total").cast("string"),
                                                      F.lit(" labelled)")).alias("rule"))


def agg_cheapest_per_site(pairs: DataFrame) -> DataFrame:
    """The lowest matching price of each site for each deal. Needs deal, site, price and whatever else a listing has."""
    rest = [c for c in pairs.columns if c not in ("deal", "site", "price")]
    best = pairs.groupBy("deal", "site").agg(F.min(F.struct("price", *rest)).alias("b"))
    return best.select("deal", "site", "b.*")


def agg_market_median(deals: DataFrame, points: DataFrame, min_sites: int = 2) -> DataFrame:
    """Deals other sites also price: the median there, the percent below it, and the market as the basis. Needs
    deals(deal, price, basis), points(deal, site, price), one row per site."""
    market = (points.groupBy("deal").agg(F.percentile("price", 0.5).alias("m"), F.count("*").alias("sites"))
              .where(F.col("sites") >= min_sites))
    df = deals.join(market, "deal", "left").withColumn("market_median", rounded(F.col("m"), 2))
    return df.withColumns({
        "verified_pct": F.when(F.col("m").isNotNull(), F.coalesce(fn_pct(F.col("price"), F.col("market_median")), F.lit(0.0))),
        "basis": F.when(F.col("m").isNotNull(), "market").otherwise(F.col("basis"))}).drop("m")


def agg_evidence_status(evidence: DataFrame) -> DataFrame:
    """How each offer is known and how far that is trusted. Needs offer, kind, source, live."""
    live = evidence.where("live")
    flags = live.groupBy("offer").agg(
        F.max(F.col("kind").isin("official", "rewards")).alias("page"), F.max(F.col("kind") == "list").alias("listed"),
        F.max(F.col("kind") == "article").alias("article"), F.max(F.col("kind") == "yours").alias("yours"),
        F.count_distinct(F.when(F.col("kind") == "list", F.col("source"))).alias("lists"),
        F.min(F.when(F.col("kind").isin("official", "rewards"), F.col("source"))).alias("page_source"),
        F.min(F.when(F.col("kind") == "list", F.col("source"))).alias("list_source"),
        F.min(F.when(F.col("kind") == "article", F.col("source"))).alias("article_source"))
    status = (F.when(F.col("page"), "confirmed").when(F.col("listed"), "listed").when(F.col("article"), "reported")
              .when(F.col("yours"), "yours").otherwise(""))
    df = evidence.select("offer").distinct().join(flags, "offer", "left").withColumn("status", status)
    source = F.when(F.col("status") == "confirmed", F.col("page_source")).when(F.col("status") == "listed", F.col("list_source")).otherwise(F.col("article_source"))
    strength = F.when((F.col("status") == "listed") & (F.col("lists") >= 2), "listed2").otherwise(F.col("status"))
    return df.select("offer", "status", evidence_weight(strength).alias("weight"), status_words(F.col("status"), source, F.col("lists")).alias("status_text"))


def agg_place_dedupe(places: DataFrame, per_degree: int = 500) -> DataFrame:
    """One place per chain and small square: a shop's point and its outline are one. The lowest ref stays."""
    y, x = square(F.col("lat"), F.col("lon"), per_degree)
    rest = [c for c in places.columns if c != "chain"]
    best = places.groupBy("chain", y.alias("_y"), x.alias("_x")).agg(F.min_by(F.struct(*rest), F.col("ref")).alias("p"))
    return best.select("chain", "p.*")


def agg_points_union(points: DataFrame, runs: int = 3, of_last: int = 6, per_degree: int = 300) -> DataFrame:
    """The union of a chain's newest non-empty scrapes among the last ones made, one point per small square, the newest
    first. Needs chain, run, lat, lon, ref; the list of runs and of each chain's runs is small."""
    made = points.select("run").distinct().withColumn("_r", F.row_number().over(Window.orderBy(F.col("run").desc()))).where(F.col("_r") <= of_last)
    used = (points.select("chain", "run").distinct().join(made.select("run"), "run", "left_semi")
            .withColumn("_r", F.dense_rank().over(Window.partitionBy("chain").orderBy(F.col("run").desc()))).where(F.col("_r") <= runs))
    y, x = square(F.col("lat"), F.col("lon"), per_degree)
    kept = points.join(used, ["chain", "run"]).groupBy("chain", y.alias("_y"), x.alias("_x")).agg(
        F.min(F.struct("_r", "ref", "run", "lat", "lon")).alias("p"))
    return kept.select("chain", "p.ref", "p.run", "p.lat", "p.lon")


def agg_site_directory(pois: DataFrame, kinds: DataFrame, per_degree: int = 500) -> DataFrame:
    """One row per site: its most common name, its kinds, what they sell and how many places it has. Needs
    pois(website, kind, name, lat, lon, ref), kinds(kind, categories)."""
    y, x = square(F.col("lat"), F.col("lon"), per_degree)
    p = (pois.withColumn("host", fn_host(F.col("website"))).where("host <> '' AND lat IS NOT NULL AND lon IS NOT NULL")
         .join(kinds, "kind").groupBy("host", y.alias("_y"), x.alias("_x"))
         .agg(F.min_by(F.struct("name", "kind", "categories"), F.col("ref")).alias("p")).select("host", "p.*"))
    names = p.groupBy("host", "name").agg(F.count("*").alias("n")).groupBy("host").agg(
        F.min_by("name", F.struct((-F.col("n")).alias("n"), F.col("name").alias("t"))).alias("name"), F.sum("n").alias("places"))
    sells = (p.select("host", "kind", "categories").distinct().groupBy("host")
             .agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories")))
    return names.join(sells, "host")


def agg_merchant_table(ads: DataFrame, nearest: DataFrame, radius_mi: float, mapped: DataFrame | None = None) -> DataFrame:
    """Per area and ad merchant: its ads, status and nearest miles. A merchant with a place in reach is "nearby"; without one it is "far"
    if the map covers it, which `mapped`(merchant) or a place farther off says, else "unmapped". Needs ads(area, merchant), nearest(area,
    chain, distance_mi)."""
    m = ads.groupBy("area", "merchant").agg(F.count("*").alias("ads"))
    df = m.join(nearest.select("area", F.col("chain").alias("merchant"), "distance_mi"), ["area", "merchant"], "left")
    covered = F.col("distance_mi").isNotNull()
    if mapped is not None:
        df = df.join(mapped.select("merchant").distinct().withColumn("_mapped", F.lit(True)), "merchant", "left")
        covered = covered | F.coalesce("_mapped", F.lit(False))
    return df.withColumn("status", F.when(F.col("distance_mi") <= radius_mi, "nearby").when(covered, "far").otherwise("unmapped")).drop("_mapped").select("area", "merchant", "ads", "distance_mi", "status")


def agg_coverage_report(items: DataFrame, hits: DataFrame, deals: DataFrame, top: int = 3) -> DataFrame:
    """Per merchant: ads, items, items with a search hit, deals, and the most common reasons items were left out. Needs
    items(merchant, ad, item, reason), hits(merchant, item), deals(merchant)."""
    base = items.groupBy("merchant").agg(F.count_distinct("ad").alias("ads"), F.count_distinct("ad", "item").alias("items"))
    found = (items.select("merchant", "ad", "item").distinct().join(hits.select("merchant", "item").distinct(), ["merchant", "item"], "left_semi")
             .groupBy("merchant").agg(F.count("*").alias("with_hit")))
    n_deals = deals.groupBy("merchant").agg(F.count("*").alias("deals"))
    why = (items.where("reason IS NOT NULL").groupBy("merchant", "reason").agg(F.count("*").alias("n"))
           .withColumn("at", F.row_number().over(Window.partitionBy("merchant").orderBy(F.col("n").desc(), "reason"))).where(F.col("at") <= top)
           .groupBy("merchant").agg(F.array_sort(F.collect_list(F.struct("at", F.concat_ws(" ", "reason", "n").alias("r")))).alias("w"))
           .select("merchant", F.array_join("w.r", ", ").alias("reasons")))
    return (base.join(found, "merchant", "left").join(n_deals, "merchant", "left").join(why, "merchant", "left")
            .fillna(0, ["with_hit", "deals"]).fillna("", ["reasons"]))


def agg_quality_metrics(local: DataFrame, online: DataFrame) -> DataFrame:
    """Shares that say how strong the evidence is. Needs local(basis, store_status), online(product, sites, basis)."""
    share = lambda p: rounded(F.avg(p.cast("int")), 3)                                          # noqa: E731
    a = local.agg(F.count("*").alias("local_deals"), share(F.col("basis") == "store_regular").alias("firm_basis_share"),
                  share(F.col("store_status") == "unmapped").alias("unconfirmed_store_share"))
    b = online.agg(F.count("*").alias("online_deals"), F.count_if(F.col("product") != "").alias("with_identity"),
                   F.count_if(F.col("sites") >= 2).alias("with_two_sites"),
                   *[share(F.col("basis") == x).alias(f"basis_{x}") for x in ("market", "store_regular", "list")])
    return a.crossJoin(b)                                     # one row each


def agg_verdict_rollup(verdicts: DataFrame) -> DataFrame:
    """Verdicts per run and category, per run, and in all, with the pass rate of the conclusive ones."""
    n = lambda v: F.count_if(F.col("verdict") == v)                                             # noqa: E731
    df = verdicts.rollup("run", "category").agg(n("pass").alias("passed"), n("fail").alias("failed"),
                                                n("inconclusive").alias("inconclusive"), n("pending").alias("pending"))
    total = F.col("passed") + F.col("failed")
    return df.withColumn("pass_rate", F.when(total > 0, rounded(F.col("passed") / total, 3)))


def agg_price_history(points: DataFrame, products: Sequence, since: Column) -> DataFrame:
    """The products' observations since a moment, in order of time."""
    return (points.where(F.col("product").isin(*products) & (F.col("observed_at") > since))
            .select("product", "site", "price", "observed_at").orderBy("product", "observed_at", "site", "price"))


def agg_counts_payload(sales: DataFrame) -> DataFrame:
    return sales.agg(F.count("*").alias("sales"), F.count_distinct(F.coalesce(F.nullif("store", F.lit("")), F.col("store_name"))).alias("stores"))


def agg_items_without_hit(items: DataFrame, hits: DataFrame) -> DataFrame:
    """Per ad, its items no search has returned. Needs items(ad, merchant, item), hits(merchant, item)."""
    return (items.select("ad", "merchant", "item").distinct().join(hits.select("merchant", "item").distinct(), ["merchant", "item"], "left_anti")
            .groupBy("ad").agg(F.count("*").alias("missing")))


def agg_token_gain(missing: DataFrame, k: int = 8, at_least: int = 5) -> DataFrame:
    """The (word, area) searches that would find the most missing items. Needs missing(item, area, words)."""
    gain = (missing.select("area", F.explode(F.array_distinct("words")).alias("word")).groupBy("word", "area").agg(F.count("*").alias("gain"))
            .where(F.col("gain") >= at_least))
    return gain.orderBy(F.col("gain").desc(), "word", "area").limit(k)


def agg_ad_overlap_by_distance(ad_at_area: DataFrame, areas: DataFrame, bin_mi: int = 10, max_mi: float = 40.0) -> DataFrame:
    """The share of ads two areas have in common, by the distance between them. Areas at one point with the same ads count
    as one with their number, so a crowd of copies makes one pair, not its square. Needs ad_at_area(area, ad), areas(id, lat, lon).

    Pairs are the work, not bytes: the cells are dealt out in a stated number of parts, a crowded cell in several; pairs too far apart go by a
    cheap bound, and where there are few ads in all a set is bits, so what two have in common is counted without comparing lists."""
    c, spark = F.col, areas.sparkSession
    sets = ad_at_area.groupBy("area").agg(F.array_sort(F.collect_set("ad")).alias("ads"))
    nodes = cut(areas.join(sets, areas.id == sets.area).groupBy("lat", "lon", "ads").agg(F.count("*").alias("w"), F.min("id").alias("id")).withColumn("n", F.size("ads")))
    ads = nodes.select(F.explode("ads").alias("ad")).distinct()
    words = -(-ads.limit(MOST_BITS + 1).count() // 64)
    if words * 64 <= MOST_BITS:
        at = ads.withColumn("at", F.row_number().over(Window.orderBy("ad")) - 1)
        bit = F.expr("shiftleft(1L, at % 64)")
        masks = [F.coalesce(F.bit_or(F.when(F.floor(c("at") / 64) == i, bit)), F.lit(0).cast("bigint")).alias(f"m{i}") for i in range(words)]
        of = nodes.select("id", F.explode("ads").alias("ad")).join(at, "ad").groupBy("id").agg(*masks)
        held = [f"m{i}" for i in range(words)]
        nodes = nodes.drop("ads").join(of, "id", "left").fillna(0, held) if held else nodes.drop("ads")
        shared = sum((F.bit_count(c(m).bitwiseAND(c("_" + m))) for m in held), F.lit(0))
    else:
        held, shared = ["ads"], F.size(F.array_intersect("ads", "_ads"))
    grid, parts = Grid(max_mi), stated_parts(spark)
    nodes = cut(nodes.withColumns({"cos": cos_lat(c("lat")), "home": grid.cell(c("lat"), c("lon"))}))
    crowd = nodes.groupBy(c("home").alias("cell")).agg(F.ceil(F.count("*") / CROWD).cast("int").alias("k"))
    own = ["id", "lat", "lon", "cos", "w", "n", *held]
    # the areas of a crowded cell are dealt to several places; who asks for the cell asks them all
    b = (nodes.withColumnRenamed("home", "cell").join(crowd, "cell").withColumn("piece", F.pmod(F.xxhash64("id"), c("k")).cast("int"))
         .select("cell", "piece", *[c(x).alias("_" + x) for x in own]))
    a = (nodes.select(*own, F.explode(grid.around(c("lat"), c("lon"))).alias("cell")).join(crowd, "cell")
         .select("cell", *own, F.explode(F.sequence(F.lit(0), c("k") - 1)).alias("piece")))
    near = (c("id") <= c("_id")) & (F.abs(c("lat") - c("_lat")) <= grid.dlat)
    mi = fn_haversine(c("lat"), c("lon"), c("_lat"), c("_lon"), c("cos"), c("_cos"))
    met = a.repartition(parts, "cell", "piece").join(b.repartition(parts, "cell", "piece").hint("shuffle_hash"), ["cell", "piece"])
    pairs = met.where(near).withColumn("mi", mi).where(F.col("mi") < max_mi)
    n = F.when(F.col("id") == F.col("_id"), F.col("w") * (F.col("w") - 1) / 2).otherwise(F.col("w") * F.col("_w"))
    pairs = pairs.withColumn("shared", shared)
    share = c("shared") / (c("n") + c("_n") - c("shared"))
    return (pairs.select(F.floor(F.col("mi") / bin_mi).alias("bin"), n.alias("n"), share.alias("share")).where("n > 0").groupBy("bin")
            .agg(F.sum("n").cast("bigint").alias("pairs"), rounded(F.sum(F.col("n") * F.col("share")) / F.sum("n"), 4).alias("share")))


def agg_learned_use(df: DataFrame) -> DataFrame:
    """How many rows each family of rules filed."""
    return df.groupBy(F.split_part("rule", F.lit(":"), F.lit(1)).alias("family")).agg(F.count("*").alias("n"))


def agg_inconclusive_reasons(verdicts: DataFrame, n: int = 25) -> DataFrame:
    return (verdicts.where("verdict = 'inconclusive'").groupBy("category", "reason").agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), "category", "reason").limit(n))


def agg_source_status(reads: DataFrame) -> DataFrame:
    """Per source: whether it could be read, its rows and the error it gave. Needs source, rows, error."""
    return reads.groupBy("source").agg(F.count_if(F.col("error").isNull()).alias("read"), F.count("error").alias("failed"),
                                       F.sum("rows").alias("rows"), F.max("error").alias("error"))


def agg_build_summary(**parts: DataFrame) -> DataFrame:
    """Rows per part of a snapshot."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out
