"""Queries of the aggregates and of the rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import windows as wn
from .catalog import query
from .inputs import Tables, rnd, using

ORDER_SQL = "score DESC, coalesce(savings, 0) DESC, title, id"


def reasons(t: Tables):
    from ..operators.filters import flt_reason
    return flt_reason(t.deals, [("no saving", F.col("pct").isNull()), ("too cheap", F.col("price") < 1000), ("hedged", F.col("hedge") != "")])


REASON = "CASE WHEN pct IS NULL THEN 'no saving' WHEN price < 1000 THEN 'too cheap' WHEN hedge <> '' THEN 'hedged' END"


@query("agg_excluded", using("deals", body=f"""
    SELECT reason, max(n) AS n FROM (SELECT {REASON} AS reason, line AS run, count(*) AS n FROM deals GROUP BY ALL) WHERE reason IS NOT NULL GROUP BY reason
    UNION ALL SELECT 'all ' || reason, count(*) FROM (SELECT {REASON} AS reason FROM deals) WHERE reason IS NOT NULL GROUP BY reason"""))
def _(t: Tables):
    df = reasons(t).withColumn("run", F.col("line"))
    return ag.agg_excluded(df, "max").unionByName(ag.agg_excluded(df).withColumn("reason", F.concat(F.lit("all "), "reason")))


@query("agg_left_out_samples", using("deals", body=f"""
    SELECT reason, max(n) AS n, string_agg(title, '; ' ORDER BY k) AS samples FROM (
      SELECT reason, title, row_number() OVER (PARTITION BY reason ORDER BY id) AS k, count(*) OVER (PARTITION BY reason) AS n
      FROM (SELECT *, {REASON} AS reason FROM deals) WHERE reason IS NOT NULL) WHERE k <= 4 GROUP BY reason"""))
def _(t: Tables):
    return (ag.agg_left_out_samples(reasons(t).withColumn("example", F.col("title")))
            .select("reason", "n", F.array_join("samples", "; ").alias("samples")))


LEX = """
    SELECT word, labels, n FROM (SELECT *, sum(n) OVER (PARTITION BY word) AS total FROM (
      SELECT word, labels, count(*) AS n FROM (SELECT list_sort(labels) AS labels, unnest(words) AS word FROM examples) GROUP BY word, labels))
    WHERE total >= 8"""
SHARE = """
    SELECT word, total, list_sort(list(category)) AS categories FROM (
      SELECT word, category, sum(n) AS n FROM (SELECT word, n, unnest(labels) AS category FROM lex) GROUP BY word, category)
    JOIN (SELECT word, CAST(sum(n) AS BIGINT) AS total FROM lex GROUP BY word HAVING sum(n) >= 8) USING (word) WHERE n >= 0.9::DOUBLE * total GROUP BY word, total"""


@query("agg_lexicon", using("examples", lex=LEX, body="SELECT word, array_to_string(labels, ',') AS labels, n FROM lex"))
def _(t: Tables):
    return ag.agg_lexicon(t.examples).select("word", F.array_join("labels", ",").alias("labels"), "n")


@query("agg_lexicon_share", using("examples", lex=LEX, share=SHARE, body="SELECT word, total, array_to_string(categories, ',') AS categories FROM share"))
def _(t: Tables):
    return ag.agg_lexicon_share(ag.agg_lexicon(t.examples)).select("word", "total", F.array_join("categories", ",").alias("categories"))


@query("agg_lexicon_classify", using("examples", lex=LEX, share=SHARE, body="""
    SELECT id, array_to_string(categories, ',') AS categories, 'learned:' || word || ' (' || total || ' labelled)' AS rule FROM (
      SELECT id, word, total, categories, row_number() OVER (PARTITION BY id ORDER BY total DESC, word DESC) AS k FROM (
        SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS word FROM documents) JOIN share USING (word)) WHERE k = 1"""))
def _(t: Tables):
    shares = ag.agg_lexicon_share(ag.agg_lexicon(t.examples))
    texts = t.read("documents").select(F.col("doc_id").alias("id"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("words"))
    return ag.agg_lexicon_classify(texts, shares).select("id", F.array_join("categories", ",").alias("categories"), "rule")


@query("agg_cheapest_per_site", using("price_points", body="""
    SELECT product AS deal, site, price, deal AS listing FROM (SELECT *, row_number() OVER (PARTITION BY product, site ORDER BY price, deal) AS k
      FROM price_points) WHERE k = 1"""))
def _(t: Tables):
    p = t.price_points.select(F.col("product").alias("deal"), "site", "price", F.col("deal").alias("listing"))
    return ag.agg_cheapest_per_site(p)


@query("agg_market_median", using("price_points", body=f"""
    WITH best AS (SELECT product AS deal, site, min(price) AS price FROM price_points GROUP BY ALL),
    m AS (SELECT deal, {rnd('quantile_cont(price, 0.5)')} AS median, count(*) AS sites FROM best GROUP BY deal HAVING count(*) >= 2)
    SELECT p_partkey AS deal, median AS market_median, CASE WHEN median IS NOT NULL THEN CASE WHEN p < median THEN {rnd('(1 - p / median) * 100', 1)}
             ELSE 0.0::DOUBLE END END AS verified_pct, CASE WHEN median IS NULL THEN 'list' ELSE 'market' END AS basis, coalesce(sites, 0) AS sites
    FROM (SELECT p_partkey, p_retailprice * 2 AS p FROM part) LEFT JOIN m ON m.deal = p_partkey"""))
def _(t: Tables):
    deals = t.read("part").select(F.col("p_partkey").alias("deal"), (F.col("p_retailprice") * 2).alias("price"), F.lit("list").alias("basis"))
    pts = ag.agg_cheapest_per_site(t.price_points.select(F.col("product").alias("deal"), "site", "price"))
    return ag.agg_market_median(deals, pts).select("deal", "market_median", "verified_pct", "basis", F.coalesce("sites", F.lit(0)).alias("sites"))


KIND = ["official", "list", "article", "yours", "rewards"]


@query("agg_evidence_status", using("posts", body="""
    WITH ev AS (SELECT seller AS offer, CASE source WHEN 'view' THEN 'official' WHEN 'click' THEN 'list' WHEN 'signup' THEN 'article' WHEN 'error' THEN 'yours'
                  ELSE 'rewards' END AS kind, 'site' || k % 4 AS source, k % 19 = seller % 19 AND price > 40 AS live FROM posts),
    s AS (SELECT offer, max(live AND kind IN ('official', 'rewards')) AS p, max(live AND kind = 'list') AS l, max(live AND kind = 'article') AS a,
             max(live AND kind = 'yours') AS y, count(DISTINCT source) FILTER (WHERE live AND kind = 'list') AS n,
             min(source) FILTER (WHERE live AND kind IN ('official', 'rewards')) AS ps, min(source) FILTER (WHERE live AND kind = 'list') AS ls,
             min(source) FILTER (WHERE live AND kind = 'article') AS src FROM ev GROUP BY offer)
    SELECT offer, CASE WHEN p THEN 'confirmed' WHEN l THEN 'listed' WHEN a THEN 'reported' WHEN y THEN 'yours' ELSE '' END AS status,
      CASE WHEN p THEN 1.0 WHEN l AND n >= 2 THEN 0.9 WHEN l THEN 0.75 WHEN a THEN 0.7 WHEN y THEN 0.5 ELSE 0.0 END::DOUBLE AS weight,
      CASE WHEN p THEN 'Confirmed on ' || ps WHEN l AND n = 1 THEN 'Listed by ' || ls WHEN l THEN 'Listed by ' || n || ' deal sites'
           WHEN a THEN 'Reported by ' || src WHEN y THEN 'Added by you' ELSE '' END AS status_text FROM s"""))
def _(t: Tables):
    s = F.col("source")
    kind = (F.when(s == "view", "official").when(s == "click", "list").when(s == "signup", "article").when(s == "error", "yours").otherwise("rewards"))
    ev = t.posts.select(F.col("seller").alias("offer"), kind.alias("kind"), F.concat(F.lit("site"), F.col("k") % 4).alias("source"),
                        ((F.col("k") % 19 == F.col("seller") % 19) & (F.col("price") > 40)).alias("live"))
    return ag.agg_evidence_status(ev)


@query("agg_site_directory", using("cities", body="""
    WITH poi AS (SELECT 'shop' || id % 37 || '.com' AS host, CASE segment WHEN 'BUILDING' THEN 'hardware' WHEN 'AUTOMOBILE' THEN 'car_parts' WHEN 'FURNITURE' THEN
                   'furniture' WHEN 'MACHINERY' THEN 'hardware' END AS kind, 'Shop ' || id % 5 AS name, lat, lon, id AS ref FROM cities),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, round_even(lat * 2, 0), round_even(lon * 2, 0) ORDER BY ref) AS r FROM poi WHERE kind IS NOT NULL) WHERE r = 1)
    SELECT host, (SELECT name FROM one o WHERE o.host = s.host GROUP BY name ORDER BY count(*) DESC, name LIMIT 1) AS name, count(*) AS places,
           string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds,
           array_to_string(list_sort(list_distinct(flatten(list(CASE kind WHEN 'hardware' THEN ['home'] WHEN 'furniture' THEN ['home', 'office'] ELSE ['auto'] END)))), ',') AS categories
    FROM one s GROUP BY host"""))
def _(t: Tables):
    seg = F.col("segment")
    kind = F.when(seg.isin("BUILDING", "MACHINERY"), "hardware").when(seg == "AUTOMOBILE", "car_parts").when(seg == "FURNITURE", "furniture").otherwise("hairdresser")
    pois = t.cities.select(F.concat(F.lit("https://www.shop"), F.col("id") % 37, F.lit(".com/us;http://other.com")).alias("website"), kind.alias("kind"),
                           F.concat(F.lit("Shop "), F.col("id") % 5).alias("name"), "lat", "lon", F.col("id").alias("ref"))
    kinds = t.spark.createDataFrame([("hardware", ["home"]), ("furniture", ["home", "office"]), ("car_parts", ["auto"])], "kind string, categories array<string>")
    d = ag.agg_site_directory(pois, kinds, 2)
    return d.select("host", "name", "places", F.array_join("kinds", ",").alias("kinds"), F.array_join("categories", ",").alias("categories"))


@query("agg_coverage_report", using("deals", body=f"""
    WITH r AS (SELECT *, {REASON} AS reason FROM deals), hits AS (SELECT DISTINCT merchant, item FROM deals WHERE line >= 4),
    why AS (SELECT merchant, string_agg(reason || ' ' || n, ', ' ORDER BY n DESC, reason) AS reasons FROM (
      SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY n DESC, reason) AS k FROM (SELECT merchant, reason, count(*) AS n FROM r WHERE reason IS NOT NULL
        GROUP BY ALL)) WHERE k <= 3 GROUP BY merchant)
    SELECT merchant, count(DISTINCT ad) AS ads, count(DISTINCT (ad, item)) AS items, (SELECT count(*) FROM (SELECT DISTINCT merchant, ad, item FROM r) x
             JOIN hits USING (merchant, item) WHERE x.merchant = r.merchant) AS with_hit, count(*) FILTER (WHERE reason IS NULL) AS deals,
           coalesce(any_value(reasons), '') AS reasons FROM r LEFT JOIN why USING (merchant) GROUP BY merchant"""))
def _(t: Tables):
    r = reasons(t)
    return ag.agg_coverage_report(r, t.deals.where("line >= 4"), r.where("reason IS NULL"))


@query("agg_quality_metrics", using("deals", body=f"""
    SELECT * FROM (SELECT count(*) AS local_deals, {rnd("avg((basis = 'store_regular')::INT)", 3)} AS firm_basis_share, {rnd('avg((merchant % 3 = 0)::INT)', 3)}
      AS unconfirmed_store_share FROM deals), (SELECT count(*) AS online_deals, count(*) FILTER (WHERE size % 2 = 0) AS with_identity,
      count(*) FILTER (WHERE line >= 2) AS with_two_sites, {rnd("avg((basis = 'market')::INT)", 3)} AS basis_market,
      {rnd("avg((basis = 'store_regular')::INT)", 3)} AS basis_store_regular, {rnd("avg((basis = 'list')::INT)", 3)} AS basis_list FROM deals WHERE pct IS NOT NULL)"""))
def _(t: Tables):
    local = t.deals.withColumn("store_status", F.when(F.col("merchant") % 3 == 0, "unmapped").otherwise("nearby"))
    online = t.deals.where("pct IS NOT NULL").withColumns({"product": F.when(F.col("size") % 2 == 0, F.col("title")).otherwise(""), "sites": F.col("line")})
    return ag.agg_quality_metrics(local, online)


@query("agg_verdict_rollup", using("verdicts", body=f"""
    SELECT *, CASE WHEN passed + failed > 0 THEN {rnd('passed / (passed + failed)::DOUBLE', 3)} END AS pass_rate FROM (
      SELECT run, category, count(*) FILTER (WHERE verdict = 'pass') AS passed, count(*) FILTER (WHERE verdict = 'fail') AS failed,
             count(*) FILTER (WHERE verdict = 'inconclusive') AS inconclusive, count(*) FILTER (WHERE verdict = 'pending') AS pending
      FROM verdicts GROUP BY ROLLUP (run, category))"""))
def _(t: Tables):
    return ag.agg_verdict_rollup(t.verdicts)


@query("agg_price_history", using("price_points", body="""
    SELECT product, site, price, strftime(observed_at, '%Y-%m-%d') AS day FROM price_points
    WHERE product IN (1, 10, 100, 101, 150) AND observed_at > TIMESTAMP '1997-03-01'"""))
def _(t: Tables):
    h = ag.agg_price_history(t.price_points, [1, 10, 100, 101, 150], F.lit("1997-03-01").cast("timestamp"))
    return h.select("product", "site", "price", F.date_format("observed_at", "yyyy-MM-dd").alias("day"))


@query("agg_counts_payload", using("posts", body="""
    SELECT count(*) AS sales, count(DISTINCT CASE WHEN k % 2 = 0 THEN 'Store ' || seller ELSE source END) AS stores FROM posts WHERE expires_at > TIMESTAMP '2024-01-20'"""))
def _(t: Tables):
    s = t.posts.where("expires_at > TIMESTAMP '2024-01-20'").withColumns(
        {"store": F.when(F.col("k") % 2 == 0, "").otherwise(F.col("source")), "store_name": F.concat(F.lit("Store "), "seller")})
    return ag.agg_counts_payload(s)


@query("agg_items_without_hit", using("deals", body="""
    SELECT ad, count(*) AS missing FROM (SELECT DISTINCT ad, merchant, item FROM deals) d WHERE NOT EXISTS (
      SELECT 1 FROM (SELECT merchant, item FROM deals WHERE line >= 4) h WHERE h.merchant = d.merchant AND h.item = d.item) GROUP BY ad"""))
def _(t: Tables):
    return ag.agg_items_without_hit(t.deals, t.deals.where("line >= 4"))


MISSING = """
    SELECT doc_id AS item, source AS area, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS word FROM documents"""


def missing_items(t: Tables):
    return t.read("documents").select(F.col("doc_id").alias("item"), F.col("source").alias("area"),
                                      F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("words"))


@query("agg_token_gain", using(body=f"SELECT word, area, count(*) AS gain FROM ({MISSING}) GROUP BY word, area HAVING count(*) >= 5 ORDER BY gain DESC, word, area LIMIT 8"))
def _(t: Tables):
    return ag.agg_token_gain(missing_items(t))


@query("agg_learned_use", using("deals", body="""
    SELECT CASE line % 4 WHEN 0 THEN 'learned' WHEN 1 THEN 'taxonomy' WHEN 2 THEN 'keywords' ELSE 'merchant' END AS family, count(*) AS n FROM deals GROUP BY 1"""))
def _(t: Tables):
    m = F.col("line") % 4
    rule = (F.when(m == 0, F.concat(F.lit("learned:"), "title")).when(m == 1, F.concat(F.lit("taxonomy:"), "category")).when(m == 2, "keywords:home").otherwise("merchant"))
    return ag.agg_learned_use(t.deals.withColumn("rule", rule))


@query("agg_inconclusive_reasons", using("verdicts", body="""
    SELECT category, 'length ' || length % 30 AS reason, count(*) AS n FROM verdicts WHERE verdict = 'inconclusive' GROUP BY ALL
    ORDER BY n DESC, category, reason LIMIT 25"""))
def _(t: Tables):
    return ag.agg_inconclusive_reasons(t.verdicts.withColumn("reason", F.concat(F.lit("length "), F.col("length") % 30)))


@query("agg_source_status", using("posts", body="""
    SELECT source, count(*) FILTER (WHERE k % 9 <> 0) AS read, count(*) FILTER (WHERE k % 9 = 0) AS failed, CAST(sum(CASE WHEN k % 9 <> 0 THEN k ELSE 0 END) AS BIGINT) AS rows,
           max(CASE WHEN k % 9 = 0 THEN 'HTTP ' || (400 + k % 5) END) AS error FROM posts GROUP BY source"""))
def _(t: Tables):
    bad = F.col("k") % 9 == 0
    return ag.agg_source_status(t.posts.select("source", F.when(bad, 0).otherwise(F.col("k")).alias("rows"),
                                               F.when(bad, F.concat(F.lit("HTTP "), (400 + F.col("k") % 5).cast("string"))).alias("error")))


@query("agg_build_summary", using("deals", "posts", body="""
    SELECT 'deals' AS part, count(*) AS n FROM deals WHERE pct IS NOT NULL UNION ALL SELECT 'sales', count(*) FROM posts WHERE expires_at IS NOT NULL
    UNION ALL SELECT 'pages', count(*) FROM pages"""))
def _(t: Tables):
    return ag.agg_build_summary(deals=t.deals.where("pct IS NOT NULL"), sales=t.posts.where("expires_at IS NOT NULL"), pages=t.read("pages"))


# --- rankings ---

@query("win_topn_capped", using("scored", body="""
    SELECT category, seller, id, score, pct, place FROM (
      SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, pct DESC, title, id) AS place FROM (
        SELECT *, merchant AS seller, row_number() OVER (PARTITION BY category, merchant ORDER BY score DESC, pct DESC, title, id) AS of_seller
        FROM scored WHERE pct IS NOT NULL) WHERE of_seller <= 5) WHERE place <= 25"""))
def _(t: Tables):
    d = t.scored.where("pct IS NOT NULL").withColumnRenamed("merchant", "seller")
    return wn.win_topn_capped(d).select("category", "seller", "id", "score", "pct", "place")


@query("win_longest_duplicate", using("deals", body="""
    SELECT merchant, title, pct, id, copies FROM (SELECT *, count(*) OVER (PARTITION BY merchant, title, pct) AS copies,
      row_number() OVER (PARTITION BY merchant, title, pct ORDER BY valid_to DESC, ad, id) AS k FROM deals) WHERE k = 1"""))
def _(t: Tables):
    d = t.deals.withColumn("ord", F.col("ad")).select("merchant", "title", "pct", "id", "valid_to", "ord")
    return wn.win_longest_duplicate(d, ["merchant", "title", "pct"]).select("merchant", "title", "pct", "id", "copies")


@query("win_lowest_price_duplicate", using("deals", body="""
    WITH l AS (SELECT item, id, price, posts FROM (SELECT *, count(*) OVER (PARTITION BY item) AS posts, row_number() OVER (PARTITION BY item ORDER BY price, id) AS k
               FROM deals) WHERE k = 1)
    SELECT l.item, l.id, l.price, l.posts, c.categories, (SELECT count(*) FROM deals d WHERE d.item = l.item AND d.id <> l.id) AS linked FROM l
    JOIN (SELECT item, string_agg(DISTINCT flag, ',' ORDER BY flag) AS categories FROM deals GROUP BY item) c USING (item)"""))
def _(t: Tables):
    d = t.deals.select("item", "id", "price", F.array("flag").alias("categories"))
    kept, links = wn.win_lowest_price_duplicate(d, "item")
    n = links.groupBy(F.col("lead").alias("id")).agg(F.count("*").alias("linked"))
    return kept.join(n, "id", "left").select("item", "id", "price", "posts", F.array_join("categories", ",").alias("categories"), F.coalesce("linked", F.lit(0)).alias("linked"))


@query("win_best_per_site", using("scored", body=f"""
    SELECT site, id, place FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {ORDER_SQL}) AS place FROM (
      SELECT *, merchant AS site, row_number() OVER (PARTITION BY merchant, title ORDER BY {ORDER_SQL}) AS k FROM scored) WHERE k = 1) WHERE place <= 12"""))
def _(t: Tables):
    d = t.scored.select(F.col("merchant").alias("site"), "title", "score", "savings", "id")
    return wn.win_best_per_site(d).select("site", "id", "place")


@query("win_detail_lead", using("scored", body=f"""
    SELECT area, radius, category, id, place FROM (SELECT *, row_number() OVER (PARTITION BY area, radius, category ORDER BY {ORDER_SQL}) AS place FROM (
      SELECT merchant % 10 AS area, line % 3 AS radius, unnest([category, flag]) AS category, id, score, savings, title FROM scored)) WHERE place <= 24"""))
def _(t: Tables):
    d = t.scored.select((F.col("merchant") % 10).alias("area"), (F.col("line") % 3).alias("radius"), F.array("category", "flag").alias("categories"), "id", "score",
                        "savings", "title")
    return wn.win_detail_lead(d).select("area", "radius", "category", "id", "place")


@query("win_best_per_store", using("scored", body="""
    SELECT store, id, score FROM (SELECT *, merchant AS store, row_number() OVER (PARTITION BY merchant ORDER BY score DESC, id) AS k FROM scored WHERE score > 0) WHERE k = 1"""))
def _(t: Tables):
    return wn.win_best_per_store(t.scored.select(F.col("merchant").alias("store"), "id", "score")).select("store", "id", "score")


@query("win_kind_pool", using("scored", body="""
    SELECT kind, brand, id, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, brand, id) AS place FROM (
      SELECT *, category AS kind, row_number() OVER (PARTITION BY category, brand ORDER BY score DESC, id) AS k FROM scored WHERE score > 0) WHERE k = 1) WHERE place <= 12"""))
def _(t: Tables):
    d = t.scored.select(F.col("category").alias("kind"), "brand", F.col("score").alias("rank"), "id")
    return wn.win_kind_pool(d).select("kind", "brand", "id", "place")


@query("win_latest_reads", using("reads", body="""
    SELECT key, id, place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY checked_at DESC, id DESC) AS place FROM reads) WHERE place <= 5"""))
def _(t: Tables):
    return wn.win_latest_reads(t.reads).select("key", "id", "place")


@query("win_order_check", using("posts", body="""
    SELECT id, price, before FROM (SELECT id, price, lag(price) OVER (PARTITION BY 1 ORDER BY id) AS before, lag(id) OVER (PARTITION BY 1 ORDER BY id) AS last FROM posts)
    WHERE price > before AND id = last + 1"""))
def _(t: Tables):
    rows = t.posts.select(F.lit(1).alias("list"), F.col("id").alias("pos"), F.col("price").alias("score"))
    return wn.win_order_check(rows).select(F.col("pos").alias("id"), F.col("score").alias("price"), "before")


@query("win_round_robin_sample", using("scored", body="""
    SELECT id, category, turn FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('7|' || id), id) AS turn FROM scored) ORDER BY turn, category LIMIT 200"""))
def _(t: Tables):
    return wn.win_round_robin_sample(t.scored.select("id", "category"), "category", 200, 7).select("id", "category", "turn")


@query("win_stratified_cities", using("cities", body="""
    SELECT id, stratum FROM (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('7|' || id), id) AS k FROM (
      SELECT *, CASE WHEN population >= 900000 THEN 'large' WHEN population >= 200000 THEN 'mid' ELSE 'small' END AS stratum FROM cities))
    WHERE k <= CASE stratum WHEN 'small' THEN 4 ELSE 3 END"""))
def _(t: Tables):
    return wn.win_stratified_cities(t.cities, 900_000, 200_000, 7).select("id", "stratum")


@query("win_quota_replace", using("verdicts", body="""
    SELECT category, test, verdict FROM (SELECT *, coalesce(sum((verdict <> 'inconclusive')::INT) OVER (PARTITION BY category ORDER BY length, test
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM verdicts) WHERE done < 20"""))
def _(t: Tables):
    v = t.verdicts.withColumn("pos", F.struct("length", "test"))
    return wn.win_quota_replace(v, 20).select("category", "test", "verdict")


@query("win_weighted_sample", using("cities", body="""
    SELECT id, population FROM cities ORDER BY -ln((('0x' || substr(md5('7|' || id), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657.0::DOUBLE) / greatest(population, 500), id LIMIT 60"""))
def _(t: Tables):
    return wn.win_weighted_sample(t.cities, 60, 7).select("id", "population")
