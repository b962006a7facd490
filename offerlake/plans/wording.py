"""Queries of the column functions and of the jobs that read offers out of texts. Texts are written from the tables' numbers,
and the oracle answers from the numbers, so what is read is checked by a round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (fn_ad_end_local, fn_ad_start_local, fn_basis_weight, fn_clean, fn_fold, fn_host, fn_hosts, fn_money, fn_nearest_year,
                         fn_norm, fn_offer_words, fn_overlap, fn_pct, fn_phrase_near, fn_product_ids, fn_site_key, fn_summary, fn_tidy, fn_words, tm_text)
from ..functions.amounts import rounded
from ..operators import terms as tr
from ..operators.sales import (job_promo_dates, job_sale_code_shipping_conditions, job_sale_dates, job_sale_name, job_sale_offer, jn_unknown_store)
from .catalog import query
from .inputs import WEIGHT, Tables, rnd, using

ENGLISH = "(SELECT doc_id, text, source FROM documents WHERE lang = 'en')"


def usd(col: str):
    return F.concat(F.lit("$"), F.format_number(F.col(col), 2))


def case(col: str, *values):
    """The value of the column's number, counted from 1; the others are not worked out. A number without a value is an error."""
    n, picked = F.col(col), F.when(F.lit(False), F.lit(None))
    for i, v in enumerate(values, 1):
        picked = picked.when(n == i, F.lit(v) if isinstance(v, str) else v)
    return picked.when(n.isNotNull(), F.raise_error(F.lit("no value has this number")))


@query("fn_norm", """
    SELECT doc_id, md5(regexp_replace(replace(lower(text), '&', 'and'), '[^a-z0-9]', '', 'g')) AS key FROM documents""")
def _(t: Tables):
    return t.read("documents").select("doc_id", F.md5(fn_norm(F.col("text"))).alias("key"))


@query("fn_fold", """
    SELECT doc_id, md5(regexp_replace(replace(lower(strip_accents(text)), '&', 'and'), '[^a-z0-9]', '', 'g')) AS key FROM documents""")
def _(t: Tables):
    return t.read("documents").select("doc_id", F.md5(fn_fold(F.col("text"))).alias("key"))


@query("fn_clean", r"""
    WITH q AS (SELECT doc_id, text, translate(translate('“' || text || '” ®', '’‘“”', '''''""'), '–—−®™', '---') AS t FROM documents)
    SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0b\f\r\x{00a0}]+', ' ', 'g'))) AS cleaned,
           md5(trim(regexp_replace(regexp_replace(t, '[ \t\n\x0b\f\r]+', ' ', 'g'), '[ \t\n\x0b\f\r]+([.,;:!?])', '\1', 'g'))) AS quoted FROM q""")
def _(t: Tables):
    return t.read("documents").select("doc_id", F.md5(fn_clean(F.col("text"))).alias("cleaned"), F.md5(fn_tidy(F.concat(F.lit("“"), "text", F.lit("” ®")))).alias("quoted"))


@query("fn_money", using("deals", body="SELECT line, count(*) AS n, CAST(sum(CASE WHEN line <> 4 THEN CAST(round(price * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS cents FROM deals GROUP BY line"))
def _(t: Tables):
    text = case("line", F.concat(F.lit("Only "), usd("price")), F.concat(F.lit("now $"), F.col("price").cast("string")), F.concat(F.format_number("price", 2), F.lit(" each")),
                F.lit("$0.00 down"), F.concat(usd("price"), F.lit(" or $3")), F.concat(F.lit("price: "), usd("price")), F.col("price").cast("string"))
    m = t.spread_deals.select("line", fn_money(text).alias("m"))
    return m.groupBy("line").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.round(F.col("m") * 100).cast("bigint"), F.lit(0))).alias("cents"))


@query("fn_pct", using("deals", body="SELECT pct, count(*) AS n FROM deals GROUP BY pct"))
def _(t: Tables):
    return t.spread_deals.select(fn_pct(F.col("price"), F.col("regular")).alias("pct")).groupBy("pct").agg(F.count("*").alias("n"))


@query("fn_ad_end_local", using("deals", body="""
    SELECT line, CAST(sum(epoch(CASE line WHEN 1 THEN timezone('America/Denver', d + INTERVAL 86399 SECOND) WHEN 2 THEN timezone('America/Denver', d - INTERVAL 1 SECOND)
             WHEN 3 THEN timezone('UTC', d + INTERVAL 15 HOUR) WHEN 4 THEN timezone('America/Denver', d) WHEN 5 THEN timezone('America/Denver', d)
             WHEN 6 THEN timezone('UTC', d + INTERVAL 23 HOUR) ELSE NULL END)) AS BIGINT) AS seconds, count(*) AS n FROM (SELECT line, valid_to AS d FROM deals) GROUP BY line"""))
def _(t: Tables):
    day, zone = F.date_format("valid_to", "yyyy-MM-dd"), F.lit("America/Denver")
    end, start = lambda tail: fn_ad_end_local(F.concat(day, F.lit(tail)), zone), lambda tail: fn_ad_start_local(F.concat(day, F.lit(tail)), zone)
    at = case("line", end("T23:59:59-04:00"), end("T03:59:59Z"), end("T10:00:00-05:00"), start("T04:00:00Z"), start("T00:00:00-05:00"), start("T18:00:00-05:00"), end("T10:00:00"))
    return t.spread_deals.select("line", F.unix_seconds(at).alias("s")).groupBy("line").agg(F.sum("s").alias("seconds"), F.count("*").alias("n"))


@query("fn_host", """
    SELECT host, count(*) AS n FROM (SELECT regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^www[.]', '') AS host FROM pages) GROUP BY host
    UNION ALL SELECT 'through ' || host, count(*) FROM (SELECT regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^www[.]', '') AS host FROM pages) GROUP BY host""")
def _(t: Tables):
    p = t.read("pages")
    via = F.concat(F.lit("https://click.aff.net/r?id=3&u="), F.url_encode("url"))
    inner = p.select(F.explode(fn_hosts(via)).alias("h")).where("h <> 'click.aff.net'").select(F.concat(F.lit("through "), "h").alias("host"))
    return p.select(fn_host(F.col("url")).alias("host")).unionByName(inner).groupBy("host").agg(F.count("*").alias("n"))


@query("fn_nearest_year", using("deals", body="""
    SELECT y, count(*) AS n, CAST(sum(date_diff('day', DATE '1990-01-01', day)) AS BIGINT) AS days FROM (
      SELECT year(day) - year(ref) AS y, day FROM (SELECT ref, arg_min(day, abs(date_diff('day', day, ref)) * 10 + (year(day) - year(ref)) + 1) AS day FROM (
        SELECT id, CAST(valid_from AS DATE) AS ref, unnest([try_cast((year(valid_from) - 1) || md AS DATE), try_cast(year(valid_from) || md AS DATE),
                 try_cast((year(valid_from) + 1) || md AS DATE)]) AS day FROM (SELECT *, '-' || lpad((line + 5)::VARCHAR, 2, '0') || '-' || lpad((size % 31 + 1)::VARCHAR, 2, '0') AS md FROM deals))
        GROUP BY id, ref)) GROUP BY y"""))
def _(t: Tables):
    day = fn_nearest_year(F.col("line") + 5, F.col("size") % 31 + 1, F.to_date("valid_from"))
    d = t.spread_deals.select(F.to_date("valid_from").alias("ref"), day.alias("day"))
    return d.groupBy((F.year("day") - F.year("ref")).alias("y")).agg(F.count("*").alias("n"), F.sum(F.datediff("day", F.lit("1990-01-01").cast("date"))).alias("days"))


@query("fn_words", f"""
    SELECT doc_id, count(*) AS n, md5(string_agg(w, ',' ORDER BY w)) AS words FROM (
      SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_extract_all(lower(replace(text, '’', '''')), '[a-z][a-z0-9]*(?:[''&+-][a-z0-9]+)*')), '''s?$', '') AS w FROM documents)
    WHERE length(w) >= 3 AND NOT regexp_matches(w, '^[a-z]{{1,2}}[0-9]') AND w NOT IN (SELECT unnest(string_split('""" + " ".join(__import__("offerlake.functions.text", fromlist=["NOT_GOODS"]).NOT_GOODS) + """', ' ')))
    GROUP BY doc_id""")
def _(t: Tables):
    d = t.read("documents").select("doc_id", fn_words(F.col("text")).alias("w"))
    return d.where(F.size("w") > 0).select("doc_id", F.size("w").cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort("w"), ",")).alias("words"))


@query("fn_overlap", """
    WITH w AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS ws FROM documents),
    p AS (SELECT a.doc_id, len(list_intersect(a.ws, b.ws))::DOUBLE AS s, len(a.ws) AS na, len(b.ws) AS nb FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, CASE WHEN na + nb - s > 0 THEN floor(s / (na + nb - s) * 10000 + 0.5) / 10000 ELSE 0.0 END AS jaccard,
           CASE WHEN least(na, nb) > 0 THEN floor(s / least(na, nb) * 10000 + 0.5) / 10000 ELSE 0.0 END AS overlap,
           CASE WHEN na > 0 THEN floor(s / na * 10000 + 0.5) / 10000 ELSE 0.0 END AS containment FROM p""")
def _(t: Tables):
    w = t.read("documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("ws"))
    nxt = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("ws").alias("ns"))
    return w.join(nxt, "doc_id").select("doc_id", *[rounded(fn_overlap(F.col("ws"), F.col("ns"), k), 4).alias(k) for k in ("jaccard", "overlap", "containment")])


@query("fn_phrase_near", using("deals", body="""
    SELECT found, lo, count(*) AS n FROM (SELECT gap + 10 <= 60 AS found, CASE WHEN gap + 10 <= 60 THEN size + 1 END AS lo FROM (SELECT size, quantity::BIGINT * 2 AS gap FROM deals)) GROUP BY ALL"""))
def _(t: Tables):
    # "<size dots> ALPHA <gap dots> beta": the phrases span gap + 10 characters with the blank between
    text = F.concat(F.repeat(F.lit("."), F.col("size")), F.lit(" ALPHA"), F.repeat(F.lit("-"), (F.col("quantity") * 2).cast("int")), F.lit(" beta and more"))
    near = fn_phrase_near(text, F.array(F.lit("alpha"), F.lit("Beta ")), 60)
    return t.spread_deals.select(near.alias("x")).select("x.found", "x.lo").groupBy("found", F.col("lo").cast("bigint").alias("lo")).agg(F.count("*").alias("n"))


@query("fn_basis_weight", using("deals", body=f"SELECT basis, count(*) AS n, max({WEIGHT.format(b='basis')}) AS weight FROM deals GROUP BY basis"))
def _(t: Tables):
    return t.spread_deals.groupBy("basis").agg(F.count("*").alias("n"), F.max(fn_basis_weight(F.col("basis"))).alias("weight"))


@query("fn_site_key", "SELECT page_id, -(('0x' || substr(sha1(regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^www[.]', '')), 1, 12))::BIGINT) AS key FROM pages")
def _(t: Tables):
    return t.read("pages").select("page_id", fn_site_key(fn_host(F.col("url"))).alias("key"))


@query("fn_summary", using("deals", body="""
    SELECT summary, count(*) AS n FROM (SELECT CASE line WHEN 1 THEN printf('%d for $%s ($%s ea)', 2, m(price), m(price / 2)) WHEN 2 THEN printf('$%s/lb', m(price)) WHEN 3 THEN 'buy 1 get 1 free'
      WHEN 4 THEN size || '% off' WHEN 5 THEN printf('$%s off', m(price)) WHEN 6 THEN '$' || m(price) || ', reg. $' || m(price + 10) || ', 5% off' ELSE '$' || m(price) || ', list $' || m(price + 10) || ', from' END AS summary
      FROM (SELECT line, size, floor(price / 50000) * 50000 + 0.25::DOUBLE AS price FROM deals)) GROUP BY summary""".replace("m(price / 2)", "format('{:,.2f}', price / 2)").replace("m(price + 10)", "format('{:,.2f}', price + 10)").replace("m(price)", "format('{:,.2f}', price)")))
def _(t: Tables):
    d = t.spread_deals.select("line", "size", (F.floor(F.col("price") / 50000) * 50000 + 0.25).alias("p"))
    on = lambda lines, v: F.when(F.col("line").isin(*lines), v)                                  # noqa: E731
    p = F.col("p")
    terms = F.struct(
        on([1, 2, 6, 7], p).alias("price"), on([6, 7], p + 10).alias("regular"), on([5], p).alias("savings"), F.coalesce(on([4], F.col("size").cast("double")), on([6], F.lit(5.0))).alias("pct"),
        F.when(F.col("line") == 7, "list").otherwise("store_regular").alias("basis"), F.when(F.col("line") == 1, 2).otherwise(1).alias("qty"), on([1], p).alias("bundle_price"),
        F.when(F.col("line") == 3, "buy 1 get 1 free").otherwise("").alias("bogo"), F.when(F.col("line") == 7, "from").otherwise("").alias("hedge"),
        F.when(F.col("line") == 2, "lb").otherwise("").alias("unit"), F.col("line").isin(3, 4, 5).alias("promo"))
    return d.select(fn_summary(terms).alias("summary")).groupBy("summary").agg(F.count("*").alias("n"))


@query("fn_offer_words", using("deals", body="""
    SELECT title, brand, array_to_string(list_sort(list_filter(string_split(title || ' $5 half', ' '), lambda w: w <> 'new')), ',') AS words, count(*) AS n
    FROM (SELECT title, brand FROM deals) GROUP BY title, brand"""))
def _(t: Tables):
    text = F.concat(F.lit("Get a "), F.col("title"), F.lit(" for $5 at 1/2 price every Tuesday, Acme"))
    w = fn_offer_words(text, F.lit("Acme Co"))
    return t.spread_deals.select("title", "brand", F.array_join(F.array_sort(w), ",").alias("words")).groupBy("title", "brand", "words").agg(F.count("*").alias("n"))


@query("fn_product_ids", using("deals", body="""
    SELECT 'B0' || lpad(item::VARCHAR, 8, '0') || CASE WHEN line % 2 = 0 THEN ',C0' || lpad(size::VARCHAR, 8, '0') ELSE '' END AS ids, count(*) AS n FROM deals GROUP BY 1"""))
def _(t: Tables):
    a, b = F.concat(F.lit("b0"), F.lpad(F.col("item").cast("string"), 8, "0")), F.concat(F.lit("C0"), F.lpad(F.col("size").cast("string"), 8, "0"))
    links = F.array(F.concat(F.lit("https://www.shop.com/x/dp/"), a, F.lit("?tag=1 and /gp/product/"), a), F.when(F.col("line") % 2 == 0, F.concat(F.lit("shop.com/gp/aw/d/"), b)))
    return t.spread_deals.select(F.array_join(fn_product_ids(links), ",").alias("ids")).groupBy("ids").agg(F.count("*").alias("n"))


@query("tm_text", """
    SELECT text, count(*) AS n FROM (SELECT CASE o_orderkey % 8 WHEN 0 THEN 'Every ' || dayname(DATE '2024-01-01' + (o_orderkey % 7)::INTEGER) || ', 2–5 pm'
      WHEN 1 THEN 'Monday to Friday, after 5 pm' WHEN 2 THEN 'Tuesdays and Thursdays' WHEN 3 THEN 'Every day, until noon' WHEN 4 THEN 'First Tuesday of the month'
      WHEN 5 THEN 'The ' || (o_orderkey % 28 + 1) || CASE WHEN (o_orderkey % 28 + 1) BETWEEN 10 AND 20 THEN 'th' WHEN (o_orderkey % 28 + 1) % 10 = 1 THEN 'st'
             WHEN (o_orderkey % 28 + 1) % 10 = 2 THEN 'nd' WHEN (o_orderkey % 28 + 1) % 10 = 3 THEN 'rd' ELSE 'th' END || ' of each month'
      WHEN 6 THEN 'Sunday to Tuesday, 11:30 am–2 pm and 9 pm–midnight' ELSE 'Mondays, Wednesdays and Fridays' END AS text FROM orders) GROUP BY text""")
def _(t: Tables):
    k = F.col("o_orderkey") % 8
    ints = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")                        # noqa: E731
    day = (F.col("o_orderkey") % 7).cast("int")
    days = (F.when(k == 0, F.array(day)).when(k == 1, ints(4, 2, 0, 1, 3)).when(k == 2, ints(3, 1)).when(k == 3, ints(*range(7))).when(k == 6, ints(0, 1, 6))
            .when(k == 7, ints(0, 2, 4)).otherwise(ints()))
    monthly = F.when(k == 4, "1:1").when(k == 5, F.concat(F.lit("d:"), (F.col("o_orderkey") % 28 + 1).cast("string"))).otherwise("")
    span = lambda *ws: F.array(*[F.struct(F.lit(a).cast("int").alias("a"), F.lit(b).cast("int").alias("b")) for a, b in ws])      # noqa: E731
    none = F.filter(span((0, 0)), lambda x: F.lit(False))
    windows = (F.when(k == 0, span((14 * 3600, 17 * 3600))).when(k == 1, span((17 * 3600, None))).when(k == 3, span((None, 12 * 3600)))
               .when(k == 6, span((11 * 3600 + 1800, 14 * 3600), (21 * 3600, 23 * 3600 + 59 * 60))).otherwise(none))
    return t.read("orders").select(tm_text(days, monthly, windows).alias("text")).groupBy("text").agg(F.count("*").alias("n"))


# --- ad items ---

def ad_items(t: Tables):
    """Each line as an ad item in one of seven wordings of its price and saving."""
    c = F.col
    none = F.lit(None).cast("string")
    return t.spread_deals.select(
        "id", "line", "size", "price", "regular",
        case("line", c("title"), c("title"), F.concat("title", F.lit(" each")), F.concat("title", F.lit(" select styles")), c("title"), F.concat("title", F.lit(" reg. "), usd("regular")),
             F.concat("title", F.lit(" compare at "), usd("regular"))).alias("name"),
        F.when(c("line") == 3, "SALE 2/").otherwise(none).alias("pre_price_text"), F.when(c("line") == 4, "% OFF").otherwise(none).alias("price_text"),
        F.when(c("line") == 5, "Buy 1 get 1 50% off").otherwise(none).alias("sale_story"), F.lit("limit 3 with coupon").alias("description"), none.alias("disclaimer_text"),
        F.when(c("line") == 4, c("size").cast("double")).otherwise(c("price")).alias("p"), F.when(c("line") == 1, c("regular")).alias("original_price"),
        F.when(c("line") == 2, rounded(c("regular") - c("price"), 2)).alias("dollars_off"), F.lit(None).cast("double").alias("percent_off"), (c("line") == 7).alias("in_store_only"),
        F.when(c("line") == 6, "Club members").otherwise("").alias("membership"), (c("line") == 1).alias("feed")).withColumnRenamed("price", "_p").withColumnRenamed("p", "price")


AD_TERMS = f"""
    SELECT line, basis, promo, hedge, conditions, count(*) AS n, CAST(sum(coalesce(CAST(round(pct * 10) AS BIGINT), 0)) AS BIGINT) AS pcts,
           CAST(sum(coalesce(CAST(round(price * 100) AS BIGINT), 0)) AS BIGINT) AS cents, CAST(sum(coalesce(CAST(round(savings * 100) AS BIGINT), 0)) AS BIGINT) AS saved FROM (
      SELECT line, CASE line WHEN 3 THEN {rnd('price / 2')} WHEN 4 THEN NULL ELSE price END AS price, CASE WHEN line IN (3) THEN NULL WHEN line = 4 THEN size::DOUBLE
               WHEN line = 5 THEN 25.0 ELSE ref_pct END AS pct,
             CASE WHEN line IN (3, 4) THEN NULL WHEN line = 5 THEN {rnd('price * 25 / 100')} WHEN ref_pct IS NOT NULL THEN {rnd('ref - price')} END AS savings,
             CASE WHEN line = 5 THEN 'store_regular' WHEN line IN (3, 4) OR ref_pct IS NULL THEN 'none' WHEN line IN (1, 6) THEN 'store_regular' WHEN line = 2 THEN 'claimed_savings'
               ELSE 'list' END AS basis, line IN (4, 5) AS promo, CASE line WHEN 4 THEN 'select items' ELSE '' END AS hedge,
             'coupon required,limit 3' || CASE line WHEN 7 THEN ',in store only' WHEN 6 THEN ',Club members' ELSE '' END AS conditions
      FROM (SELECT *, CASE WHEN price < ref THEN {rnd('(1 - price / ref) * 100', 1)} END AS ref_pct FROM (
        SELECT *, CASE line WHEN 2 THEN {rnd('price + ' + rnd('regular - price'))} ELSE regular END AS ref FROM deals)))
    GROUP BY ALL"""


@query("job_ad_terms", using("deals", body=AD_TERMS))
def _(t: Tables):
    d = tr.job_ad_terms(ad_items(t)).select("line", "terms.*")
    n = lambda c, by: F.sum(F.coalesce(F.round(F.col(c) * by).cast("bigint"), F.lit(0)))          # noqa: E731
    return (d.withColumn("conditions", F.array_join("conditions", ",")).groupBy("line", "basis", "promo", "hedge", "conditions")
            .agg(F.count("*").alias("n"), n("pct", 10).alias("pcts"), n("price", 100).alias("cents"), n("savings", 100).alias("saved")))


@query("job_hedges_conditions", using("deals", body="""
    SELECT hedge, conditions, count(*) AS n FROM (SELECT CASE line WHEN 1 THEN 'up to' WHEN 2 THEN 'starting at' WHEN 3 THEN 'from' WHEN 4 THEN '& more (price varies by option)'
      ELSE '' END AS hedge, CASE line WHEN 2 THEN 'coupon required' WHEN 3 THEN 'promo code' WHEN 5 THEN 'Prime members,limit ' || size WHEN 6 THEN 'in store only,full case only'
      WHEN 7 THEN 'online only' ELSE '' END AS conditions FROM deals) GROUP BY ALL"""))
def _(t: Tables):
    text = case("line", F.concat(F.lit("Up to "), "size", F.lit("% off")), F.lit("as low as $3 with digital coupon"), F.lit("bolts from $3 w/ code"), F.lit("gears and more"),
                F.concat(F.lit("Prime Members: limit "), "size"), F.lit("In-store only, full case"), F.lit("online exclusive"))
    d = tr.job_hedges_conditions(t.spread_deals.select(text.alias("text")))
    return d.withColumn("conditions", F.array_join("conditions", ",")).groupBy("hedge", "conditions").agg(F.count("*").alias("n"))


@query("job_post_price_reference", using("deals", body=f"""
    SELECT line, basis, count(*) AS n, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(sum(coalesce(CAST(round(ref * 100) AS BIGINT), 0)) AS BIGINT) AS refs,
           CAST(sum(coalesce(CAST(round(pct * 10) AS BIGINT), 0)) AS BIGINT) AS pcts FROM (
      SELECT line, price, CASE WHEN ref > price THEN ref END AS ref, CASE WHEN ref > price THEN b ELSE 'none' END AS basis, CASE WHEN ref > price THEN {rnd('(1 - price / ref) * 100', 1)} END AS pct
      FROM (SELECT line, CASE WHEN line IN (4, 5) AND regular > price AND regular - price < 1 THEN regular ELSE price END AS price, CASE line WHEN 2 THEN {rnd('price + 25')} WHEN 6 THEN {rnd('price + 25')} WHEN 7 THEN NULL ELSE regular END AS ref,
              CASE line WHEN 1 THEN 'store_regular' WHEN 2 THEN 'editor_compare' WHEN 3 THEN 'editor_compare' WHEN 4 THEN 'list' WHEN 5 THEN 'store_regular' WHEN 6 THEN 'list' END AS b FROM deals))
    GROUP BY line, basis"""))
def _(t: Tables):
    text = case("line", F.concat(F.lit("Nice one. It was "), usd("regular"), F.lit(" last week.")), F.lit("You'd pay $25 more elsewhere."), F.concat(F.lit("Most stores charge "), usd("regular"), F.lit(".")),
                F.concat(F.lit("Good. The list price of "), usd("regular"), F.lit(" is high.")), F.concat(F.lit("It usually sells for "), usd("regular"), F.lit(".")),
                F.lit("That's a $25 savings. Ships free."), F.lit("A bolt."))
    p = t.spread_deals.select("line", F.concat(F.lit("Save $30: "), "title", F.lit(" for "), usd("price"), F.lit(" shipped")).alias("title"), text.alias("text"), F.lit(None).cast("double").alias("price"),
                       F.lit(None).cast("double").alias("reference"), F.lit(None).cast("double").alias("pct_stated"))
    d = tr.job_post_price_reference(p)
    n = lambda c, by: F.sum(F.coalesce(F.round(F.col(c) * by).cast("bigint"), F.lit(0)))          # noqa: E731
    return d.groupBy("line", "basis").agg(F.count("*").alias("n"), n("deal_price", 100).alias("cents"), n("reference_price", 100).alias("refs"), n("pct", 10).alias("pcts"))


@query("job_price_pair", using("deals", body="""
    SELECT line % 2 AS way, count(*) AS n, CAST(sum(CASE WHEN regular - price >= 1 THEN CAST(round(price * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS cents,
           CAST(sum(CASE WHEN regular - price >= 1 THEN CAST(round(regular * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS refs FROM deals GROUP BY 1"""))
def _(t: Tables):
    d = t.spread_deals.where("true")
    said = F.when(F.col("line") % 2 == 0, F.concat(F.lit(" Save $"), F.format_number(F.col("regular") - F.col("price"), 2))).otherwise(
        F.concat(F.lit(" $"), F.format_number(F.col("regular") - F.col("price"), 2), F.lit(" off at Store")))
    p = d.select("line", (F.col("regular") - F.col("price") >= 1).alias("real"), F.concat("title", said).alias("title"),
                 F.concat(F.lit("The price of "), usd("price"), F.lit(" stands against the "), usd("regular"), F.lit(" regular price, or $0.07 a piece.")).alias("text"))
    r = tr.job_price_pair(p)
    n = lambda c: F.sum(F.when(F.col("real"), F.coalesce(F.round(F.col(c) * 100).cast("bigint"), F.lit(0))).otherwise(0))
    return r.groupBy((F.col("line") % 2).alias("way")).agg(F.count("*").alias("n"), n("pair_price").alias("cents"), n("pair_reference").alias("refs"))


@query("job_post_seller", using("deals", body="""
    SELECT CASE line WHEN 1 THEN 'store' || merchant || '.com' WHEN 2 THEN 'Store ' || merchant WHEN 3 THEN 'Store' || merchant WHEN 4 THEN 'shop' || merchant || '.com' WHEN 5 THEN 'Store ' || merchant ELSE '' END AS seller,
           count(*) AS n FROM deals GROUP BY 1"""))
def _(t: Tables):
    m = F.col("merchant").cast("string")
    text = case("line", F.concat(F.lit("Bolts [ store"), m, F.lit(".com ] has them for $3")), F.concat(F.lit("a bolt via Store "), m, F.lit(" is cheap")), F.concat(F.lit("Good news. Store"), m, F.lit(" has bolts")),
                F.concat(F.lit("see https://www.shop"), m, F.lit(".com/x")), F.lit("bolts"), F.lit("bolts"), F.lit("bolts"))
    title = F.when(F.col("line") == 5, F.concat(F.lit("bolts at Store "), m)).otherwise("bolts")
    d = tr.job_post_seller(t.spread_deals.select(title.alias("title"), text.alias("text")))
    return d.groupBy(F.col("seller_said").alias("seller")).agg(F.count("*").alias("n"))


@query("job_post_gone", """
    SELECT CASE page_id % 5 WHEN 0 THEN 'the post was removed (redirects elsewhere)' WHEN 1 THEN 'the post is marked expired' WHEN 2 THEN 'the post page no longer shows this deal' WHEN 3 THEN '' END AS gone,
           count(*) AS n, CAST(sum(page_id) AS BIGINT) AS checksum FROM pages GROUP BY 1""")
def _(t: Tables):
    m = F.col("page_id") % 5
    p = t.read("pages").select("page_id", F.concat(F.lit("https://deals.com/f/"), "page_id").alias("url"), "html")
    posts = p.select("url", "page_id", F.when(m == 2, "turquoise zeppelin xylophone $3").otherwise("Zq page $5").alias("title"))
    pages = p.where(m != 4).select("url", F.when(m == 0, F.concat(F.lit("https://deals.com/home/"), "page_id")).otherwise(F.col("url")).alias("final_url"),
                                   F.when(m == 1, F.concat("html", F.lit("<b>This deal has expired</b>"))).otherwise(F.col("html")).alias("html"))
    return tr.job_post_gone(posts, pages).groupBy("gone").agg(F.count("*").alias("n"), F.sum("page_id").alias("checksum"))


@query("job_site_platform", """
    SELECT CASE page_id % 4 WHEN 0 THEN 'shopify' WHEN 1 THEN 'woocommerce' ELSE '' END AS platform, count(*) AS n, CAST(sum(page_id) AS BIGINT) AS checksum FROM pages GROUP BY 1""")
def _(t: Tables):
    tail = F.when(F.col("page_id") % 4 == 0, '<script src="//cdn.shopify.com/s.js">').when(F.col("page_id") % 4 == 1, '<link href="/wp-content/plugins/woocommerce/a.css">').otherwise("")
    p = t.read("pages").withColumn("html", F.concat("html", tail))
    return tr.job_site_platform(p).groupBy("platform").agg(F.count("*").alias("n"), F.sum("page_id").alias("checksum"))


@query("job_current_roundup_page", using("posts", body="""
    SELECT site, day, url, strftime(modified, '%Y-%m-%d') AS modified FROM (SELECT *, row_number() OVER (PARTITION BY site, day ORDER BY n DESC, modified DESC, url DESC) AS r FROM (
      SELECT source AS site, id % 7 AS day, 'https://' || source || '.com/' || lower(dayname(DATE '2024-01-01' + (id % 7)::INTEGER)) || '-restaurant-' || CASE WHEN k % 2 = 0 THEN 'specials' ELSE 'deals' END || '-' || id || '/' AS url,
             CAST(posted_at AS DATE) AS modified, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END AS n FROM posts WHERE k % 3 <> 0 AND date_diff('day', CAST(posted_at AS DATE), DATE '2024-02-20') <= 45)) WHERE r = 1"""))
def _(t: Tables):
    names = F.array(*[F.lit(d) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")])
    day = F.element_at(names, (F.col("id") % 7 + 1).cast("int"))
    what = F.when(F.col("k") % 3 == 0, "news").when(F.col("k") % 2 == 0, "restaurant-specials").otherwise("restaurant-deals")
    sitemap = t.posts.select(F.col("source").alias("site"), F.concat(F.lit("https://"), "source", F.lit(".com/"), day, F.lit("-"), what, F.lit("-"), "id", F.lit("/")).alias("url"),
                             F.to_date("posted_at").alias("modified"))
    wanted = (t.posts.select(F.col("source").alias("site")).distinct().withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(6))))
              .withColumn("old_url", F.concat(F.lit("https://x.com/daily-"), F.element_at(names, F.col("day") + 1), F.lit("-restaurant-specials/"))))
    best = tr.job_current_roundup_page(sitemap, wanted, F.lit("2024-02-20").cast("date"))
    return best.select("site", F.col("day").cast("bigint").alias("day"), "url", F.date_format("modified", "yyyy-MM-dd").alias("modified"))


# --- sales ---

def sale_posts(t: Tables):
    """Each line as a sale post in one of seven wordings."""
    s = F.col("size").cast("string")
    title = case("line", F.concat(F.lit("Fall Sale: "), s, F.lit("% off")), F.concat(F.lit("Up to "), s, F.lit("% off everything at Acme + free shipping w/ $35")),
                 F.concat(F.lit("Acme Sale: Extra "), s, F.lit("% off sale styles w/ Prime")), F.concat(F.lit("Toys: "), s, F.lit("% to "), (F.col("size") + 20).cast("string"), F.lit("% off")),
                 F.concat(F.lit("$"), s, F.lit(" off $200 + free shipping")), F.lit("Buy 2, get 1 free on toys (Acme)"), F.concat(F.lit("Spend $100, get $"), s, F.lit(" gift card")))
    return t.spread_deals.select("id", "item", "line", "size", "valid_from", "valid_to", title.alias("title"))


@query("job_sale_offer", using("deals", body="""
    SELECT offer, badge, badge_soft, bogo_pct, min_spend, off, count(*) AS n FROM (SELECT
      CASE line WHEN 1 THEN size || '% off' WHEN 2 THEN 'Up to ' || size || '% off' WHEN 3 THEN 'Extra ' || size || '% off' WHEN 4 THEN size || '–' || (size + 20) || '% off' WHEN 5 THEN '$' || size || ' off $200+'
        WHEN 6 THEN 'Buy 2 get 1 free' ELSE 'Spend $100, get $' || size || ' in gift card' END AS offer,
      CASE line WHEN 1 THEN size || '% off' WHEN 2 THEN 'Up to ' || size || '%' WHEN 3 THEN 'Extra ' || size || '%' WHEN 4 THEN size || '–' || (size + 20) || '% off' WHEN 5 THEN '$' || size || ' off'
        WHEN 6 THEN 'B2G1' ELSE '$' || size || ' off' END AS badge, line IN (2, 5, 7) AS badge_soft, CASE line WHEN 6 THEN 33.3::DOUBLE END AS bogo_pct,
      CASE line WHEN 5 THEN 200.0::DOUBLE WHEN 7 THEN 100.0::DOUBLE END AS min_spend, CASE WHEN line IN (5, 7) THEN size::DOUBLE END AS off FROM deals) GROUP BY ALL"""))
def _(t: Tables):
    return job_sale_offer(sale_posts(t)).groupBy("offer", "badge", "badge_soft", "bogo_pct", "min_spend", "off").agg(F.count("*").alias("n"))


@query("job_sale_code_shipping_conditions", using("deals", body="""
    SELECT code, code_note, shipping, conditions, count(*) AS n FROM (SELECT CASE WHEN line IN (1, 2, 7) THEN 'SAVE' || size WHEN line = 4 THEN 'SHIP' || size ELSE '' END AS code, CASE line WHEN 4 THEN 'for free shipping' ELSE '' END AS code_note,
      CASE line WHEN 2 THEN 'Free shipping on $35+' WHEN 5 THEN 'Free shipping' ELSE '' END AS shipping,
      CASE line WHEN 2 THEN 'today only' WHEN 3 THEN 'Prime members' WHEN 5 THEN 'on orders of $200+' WHEN 7 THEN 'paid as a gift card,the code is for new customers' ELSE '' END AS conditions FROM deals) GROUP BY ALL"""))
def _(t: Tables):
    s = F.col("size").cast("string")
    text = case("line", F.concat(F.lit("Bolts for all. Use promo code SAVE"), s, F.lit(" to save. No code needed.")), F.concat(F.lit("Today only. Apply coupon code \"save"), s, F.lit("\" hm. Code SAVE"), s, F.lit(" works.")),
                F.concat(F.lit("Card members use code CARD"), s, F.lit(" today. So credit card offers go.")), F.concat(F.lit("Get free shipping with code SHIP"), s, F.lit(".")), F.lit("No code HERE1 wanted."),
                F.lit("Code TODAY is here."), F.concat(F.lit("New customers save with code SAVE"), s, F.lit(".")))
    # an older wording of line 2: the lower-case quoted code is plain words with digits and so is taken; keep it apart
    text = F.when(F.col("line") == 2, F.concat(F.lit("Today only. Apply code \"here\" hm. Code SAVE"), s, F.lit(" works."))).otherwise(text)
    p = sale_posts(t).withColumns({"text": text, "posted_at": F.col("valid_from")})
    d = job_sale_code_shipping_conditions(job_sale_offer(p), F.lit("1998-06-01").cast("date"))
    return d.withColumn("conditions", F.array_join("conditions", ",")).groupBy("code", "code_note", "shipping", "conditions").agg(F.count("*").alias("n"))


@query("job_sale_dates", using("deals", body="""
    SELECT line, how, CAST(sum(date_diff('day', DATE '1990-01-01', ends)) AS BIGINT) AS ends, CAST(sum(coalesce(date_diff('day', DATE '1990-01-01', starts), 0)) AS BIGINT) AS starts, count(*) AS n FROM (
      SELECT line, CASE WHEN line = 6 THEN 'store gives this end date' WHEN line = 7 THEN '' ELSE 'the post says' END AS how, CASE line WHEN 4 THEN d WHEN 6 THEN e WHEN 7 THEN NULL WHEN 5 THEN d + (isodow(d) * 0 + (12 - isodow(d)) % 7)::INTEGER ELSE e END AS ends,
             CASE line WHEN 2 THEN s END AS starts FROM (SELECT line, CAST(valid_from AS DATE) AS d, CAST(valid_to AS DATE) AS e, CAST(valid_from AS DATE) + 3 AS s FROM deals)) GROUP BY ALL"""))
def _(t: Tables):
    md = lambda c, style: F.date_format(c, style)                                                # noqa: E731
    text = case("line", F.concat(F.lit("Ends "), md("valid_to", "MMM d"), F.lit(".")),
                F.concat(F.lit("Runs "), md(F.date_add("valid_from", 3), "MMMM d"), F.lit(" - "), md("valid_to", "MMMM d"), F.lit(".")),
                F.concat(F.lit("Good through "), md("valid_to", "M/d"), F.lit(" at stores.")), F.lit("Hurry, today only!"), F.lit("Sale ends Friday!"), F.concat(F.lit("Ends "), md("valid_from", "MMM d")), F.lit("Soon over"))
    p = t.spread_deals.select("line", F.lit("A sale").alias("title"), text.alias("text"), (F.col("valid_from") + F.make_dt_interval(hours=F.lit(12))).alias("posted_at"), F.lit("store").alias("source"),
                       F.when(F.col("line") == 6, F.col("valid_to") + F.make_dt_interval(hours=F.lit(12))).alias("expires_at"), (F.col("line") == 6).alias("expires_stated"))
    d = job_sale_dates(p, F.lit("2001-01-01").cast("timestamp"))
    day = lambda c: F.datediff(F.to_date(F.from_utc_timestamp(c, "America/Chicago")), F.lit("1990-01-01").cast("date"))       # noqa: E731
    return d.select("line", F.regexp_extract("ends_how", "^(the post says|store gives this end date)?", 1).alias("how"), day("ends_at").alias("e"), day("starts_at").alias("s")).groupBy("line", "how").agg(
        F.sum("e").alias("ends"), F.sum(F.coalesce("s", F.lit(0))).alias("starts"), F.count("*").alias("n"))


@query("job_promo_dates", using("deals", body="""
    SELECT line, how, reason, CAST(sum(date_diff('day', DATE '1990-01-01', f)) AS BIGINT) AS firsts, CAST(sum(coalesce(date_diff('day', DATE '1990-01-01', l), 0)) AS BIGINT) AS lasts, count(*) AS n FROM (
      SELECT *, CASE WHEN how = 'no dates stated' AND date_diff('day', d, DATE '1998-06-03') > 3 THEN 'promotion: no dates and posted over 3 days ago'
        WHEN timezone('America/Chicago', l::TIMESTAMP + INTERVAL 86399 SECOND) < TIMESTAMPTZ '1998-06-03 17:00:00+00' OR timezone('America/Chicago', coalesce(f, d)::TIMESTAMP) > TIMESTAMPTZ '1998-06-10 17:00:00+00'
        THEN 'promotion: outside the 7-day window' END AS reason FROM (
        SELECT line, d, CASE line WHEN 1 THEN d + 3 WHEN 3 THEN e WHEN 4 THEN d WHEN 5 THEN DATE '1998-06-09' WHEN 6 THEN d WHEN 7 THEN d END AS f, CASE line WHEN 1 THEN e WHEN 2 THEN e WHEN 3 THEN e WHEN 4 THEN d WHEN 5 THEN DATE '1998-06-10' END AS l,
               CASE line WHEN 1 THEN 'date range' WHEN 2 THEN 'end date' WHEN 3 THEN 'single date' WHEN 4 THEN 'today (post date)' WHEN 5 THEN 'recurring weekday' ELSE 'no dates stated' END AS how
        FROM (SELECT line, CAST(valid_from AS DATE) AS d, CAST(valid_to AS DATE) AS e FROM deals))) GROUP BY ALL"""))
def _(t: Tables):
    md = lambda c, style="MMM d": F.date_format(c, style)                                        # noqa: E731
    text = case("line", F.concat(md(F.date_add("valid_from", 3)), F.lit(" to "), md("valid_to")), F.concat(F.lit("through "), md("valid_to", "M/d")), F.concat(F.lit("On "), md("valid_to")),
                F.lit("Free fries today!"), F.lit("every Tuesdays deal"), F.lit("Nothing said"), F.lit("Nothing said"))
    p = t.spread_deals.select("line", F.lit("Fries for a dollar").alias("title"), text.alias("text"), (F.col("valid_from") + F.make_dt_interval(hours=F.lit(12))).alias("posted_at"),
                       F.lit(None).cast("timestamp").alias("expires_at"), F.lit(False).alias("expires_stated"))
    d = job_promo_dates(p, F.lit("1998-06-03 17:00:00").cast("timestamp"), F.lit("1998-06-10 17:00:00").cast("timestamp"))
    n = lambda c: F.sum(F.coalesce(F.datediff(c, F.lit("1990-01-01").cast("date")), F.lit(0)))
    return d.groupBy("line", F.col("dates_how").alias("how"), "reason").agg(F.sum(F.datediff("first_day", F.lit("1990-01-01").cast("date"))).alias("firsts"), n("last_day").alias("lasts"), F.count("*").alias("n"))


@query("job_sale_name", using("deals", body="""
    SELECT CASE line WHEN 1 THEN 'Fall Sale' WHEN 2 THEN 'everything' WHEN 3 THEN 'Sale' WHEN 4 THEN 'Toys' WHEN 5 THEN 'Sale' WHEN 6 THEN 'toys' ELSE 'gift card' END AS name,
           line IN (1, 2, 3, 5) AS store_event, count(*) AS n FROM (SELECT * FROM deals WHERE line <> 7 AND line <> 6) GROUP BY ALL"""))
def _(t: Tables):
    p = sale_posts(t).where("line <> 7 AND line <> 6").withColumn("store_names", F.array(F.lit("Acme"), F.lit("Acme Store")))
    return job_sale_name(p).groupBy("name", "store_event").agg(F.count("*").alias("n"))


@query("jn_unknown_store", using("deals", body="""
    SELECT CASE WHEN line IN (1, 2) THEN 'Wilson' || merchant WHEN line = 3 THEN 'Puma' || merchant ELSE '' END AS store_name, CASE line WHEN 1 THEN 'the title names it and the post links to its site'
      WHEN 2 THEN 'the title names it and the post says it ships' WHEN 3 THEN 'the title names it and the post links to its site' ELSE '' END AS store_how, count(*) AS n FROM deals GROUP BY ALL"""))
def _(t: Tables):
    m = F.col("merchant").cast("string")
    title = case("line", F.concat(F.lit("Wilson"), m, F.lit(" Fall Sale: 20% off")), F.concat(F.lit("Wilson"), m, F.lit(" Fall Sale: 20% off")), F.concat(F.lit("Puma"), m, F.lit("'s Stock Up sale is on")),
                 F.concat(F.lit("Wilson"), m, F.lit(" Fall Sale")), F.lit("Fall Sale: 20% off"), F.lit("big savings"), F.lit("Deals of the day"))
    link = case("line", F.concat(F.lit("https://go.aff.net/r?u=https%3A%2F%2Fwww.wilson"), m, F.lit(".com%2Fx")), F.lit("https://other.com/x"), F.concat(F.lit("https://shop.puma"), m, F.lit(".com/sale")),
                F.lit("https://other.com"), F.lit("https://fall.com"), F.lit("https://a.com"), F.lit("https://b.com"))
    p = t.spread_deals.select(title.alias("title"), F.when(F.col("line") == 2, "Free shipping on all").otherwise("Nice").alias("text"), F.array(link).alias("links"))
    return jn_unknown_store(p).groupBy("store_name", "store_how").agg(F.count("*").alias("n"))
