"""Joins by names: what a name stands for is decided once per distinct name, by candidate keys with a priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fn_fold, fn_norm
from ..functions.amounts import bind
from ..functions.text import fn_clean, straight
from ..functions.times import seconds_between
from ..rules import wordings as R
from ..session import cut
from .wordwork import says


def jn_item_hits(items: DataFrame, hits: DataFrame) -> DataFrame:
    """Ad items with their search hit, if one was found. Needs merchant, item on both."""
    one = hits.groupBy("merchant", "item").agg(F.min(F.struct(*[c for c in hits.columns if c not in ("merchant", "item")])).alias("hit"))
    return items.join(one, ["merchant", "item"], "left")


def jn_merchant_dim(items: DataFrame, merchants: DataFrame) -> DataFrame:
    """Items with the registry's merchant, by any of its spellings; a name the registry lacks stands for itself. Needs
    items(merchant_name), merchants(merchant, aliases)."""
    alias = (merchants.select("merchant", F.explode(F.concat(F.array("merchant"), "aliases")).alias("a")).select("merchant", fn_norm(F.col("a")).alias("key"))
             .groupBy("key").agg(F.min("merchant").alias("_registered")))
    df = items.withColumn("key", fn_norm(F.col("merchant_name"))).join(alias, "key", "left").drop("key")
    return df.withColumns({"known": F.col("_registered").isNotNull(), "merchant": F.coalesce("_registered", F.trim("merchant_name"))}).drop("_registered")


def prefixes(key: Column, least: int) -> Column:
    n = F.length(key)
    return F.when(n >= least, F.transform(F.sequence(F.lit(least), F.greatest(n, F.lit(least))), lambda k: F.substring(key, F.lit(1), k))).otherwise(
        F.array().cast("array<string>"))


def jn_alias_exact_prefix(names: DataFrame, chains: DataFrame, min_prefix: int = 6, min_places: int = 3) -> DataFrame:
    """The chain each distinct name means: an exact alias, else the longest alias it starts with, else the one chain whose
    aliases it starts; loose ways need `min_places` mapped places. Needs names(name), chains(alias, chain, places)."""
    n = names.select("name").distinct().select("name", fn_fold(F.col("name")).alias("key")).where("key <> ''")
    al = chains.select(fn_fold(F.col("alias")).alias("key"), "chain", "places").where("key <> ''").groupBy("key").agg(
        F.max(F.struct("places", "chain")).alias("c")).select("key", "c.chain", "c.places")
    exact = n.join(al.select("key", F.col("chain").alias("c")), "key").select("name", F.struct(F.lit(0).alias("way"), F.lit(0).alias("len"), F.col("c").alias("chain")).alias("r"))
    long_ = al.where(F.length("key") >= min_prefix)
    starts = (n.select("name", F.explode(prefixes(F.col("key"), min_prefix)).alias("key")).join(long_, "key")
              .select("name", F.length("key").alias("len"), "chain", "places"))
    # each prefix of an alias, where one chain only is behind it
    ahead = (al.select(F.explode(prefixes(F.col("key"), min_prefix)).alias("p"), "key", "chain", "places").groupBy("p")
             .agg(F.count_distinct("chain").alias("chains"), F.max(F.struct(F.length("key").alias("len"), "chain", "places")).alias("c")).where("chains = 1"))
    extends = n.join(ahead.withColumnRenamed("p", "key"), "key").select("name", "c.len", "c.chain", "c.places")
    loose = (starts.groupBy("name").agg(F.max(F.struct("len", "chain", "places")).alias("s")).select("name", F.lit(1).alias("way"), "s.len", "s.chain", "s.places")
             .unionByName(extends.select("name", F.lit(2).alias("way"), "len", "chain", "places")))
    # the first loose way found decides, also when its chain is too small
    first = loose.groupBy("name").agg(F.min(F.struct("way", "len", "chain", "places")).alias("r"))
    best = exact.unionByName(first.where(F.col("r.places") >= min_places).select("name", F.struct("r.way", "r.len", "r.chain").alias("r")))
    return best.groupBy("name").agg(F.min("r").alias("r")).select("name", "r.chain", F.element_at(F.array(*[F.lit(w) for w in ("exact", "prefix", "extension")]), F.col("r.way") + 1).alias("how"))


def store_keys(stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spellings and domains of the registry's stores as keys. Needs stores(store, names, domains, ord)."""
    first = lambda df, k: df.groupBy(k).agg(F.min(F.struct("ord", "store")).alias("s")).select(k, "s.store")      # noqa: E731
    names = stores.select("ord", "store", F.explode("names").alias("n")).select("ord", "store", fn_norm(straight(F.col("n"))).alias("key")).where("key <> ''")
    domains = stores.select("ord", "store", F.explode("domains").alias("domain"))
    return first(names, "key"), first(domains, "domain")


def jn_seller_store(sellers: DataFrame, stores: DataFrame) -> DataFrame:
    """The registry store each distinct seller stands for: its spelling, its domain or a parent of it, its name without
    ".com", its longest leading words. Needs sellers(seller)."""
    n = sellers.select("seller").distinct().select("seller", straight(fn_clean(F.col("seller"))).alias("n")).where("n <> ''")
    names, domains = store_keys(stores)
    words = F.split("n", " ")
    lead = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda k: F.struct((100 - k).alias("p"), fn_norm(F.array_join(F.slice(words, 1, k), " ")).alias("key")))
    keys = F.concat(F.array(F.struct(F.lit(0).alias("p"), fn_norm(F.col("n")).alias("key"))),
                    F.when(F.lower("n").endswith(".com") & (F.length("n") > 4), F.array(F.struct(F.lit(2).alias("p"), fn_norm(F.expr("substring(n, 1, length(n) - 4)")).alias("key"))))
                    .otherwise(F.array().cast("array<struct<p:int,key:string>>")),
                    F.when(F.size(words) > 1, lead).otherwise(F.array().cast("array<struct<p:int,key:string>>")))
    by_name = n.select("seller", F.explode(keys).alias("k")).select("seller", "k.p", "k.key").where("key <> ''").join(names, "key").select("seller", "p", "store")
    labels = F.split(F.regexp_replace(F.lower("n"), r"^www\.", ""), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    by_domain = n.select("seller", F.explode(suffixes).alias("domain")).join(domains, "domain").select("seller", F.lit(1).alias("p"), "store")
    return by_name.unionByName(by_domain).groupBy("seller").agg(F.min(F.struct("p", "store")).alias("b")).select("seller", "b.store")


def jn_dictionary_scan(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Every dictionary name in each text, as whole words, as written, in capitals or with a capital first letter; longer
    names first, none inside another: id, entry, event, brand, at (word position). Needs texts(id, text), names(entry, name,
    event, brand). Texts are cut to runs of as many words as some name has, which are looked up by equality."""
    bare = lambda w: F.btrim(w, F.lit(".'-"))                                                          # noqa: E731
    norm_tokens = lambda t: F.transform(F.regexp_extract_all(straight(t), F.lit(r"([\w&'.-]+)"), F.lit(1)),                            # noqa: E731
                                        lambda w: bind(bare(w), lambda x: F.when(x.endswith("'s"), x.substr(F.lit(1), F.length(x) - 2)).otherwise(x)))
    keyed = names.select("entry", "event", "brand", F.array_join(norm_tokens(F.col("name")), " ").alias("n"), F.length("name").alias("len")).where(F.length("n") >= 2)
    forms = (keyed.select("entry", "event", "brand", "len", F.explode(F.array_distinct(F.array("n", F.upper("n"), F.concat(F.upper(F.substring("n", 1, 1)), F.expr("substring(n, 2)"))))).alias("run"))
             .dropDuplicates(["run", "entry"]))
    sizes = sorted(r.n for r in keyed.select(F.size(F.split("n", " ")).alias("n")).distinct().collect())      # a few numbers
    toks = texts.select("id", norm_tokens(F.col("text")).alias("t"))
    run = lambda at, k, w: F.struct(at.alias("at"), F.lit(k).alias("n"), w.alias("run"))               # noqa: E731

    def runs_of(t: Column, k: int) -> Column:
        if k == 1:
            return F.transform(t, lambda w, i: run(i, 1, w))
        starts = F.transform(F.slice(t, 1, F.greatest(F.size(t) - (k - 1), F.lit(0))), lambda _, i: i)
        return F.transform(starts, lambda i: run(i, k, F.array_join(F.slice(t, i + 1, k), " ")))
    runs = toks.where(F.size("t") > 0).select("id", F.explode(bind(F.col("t"), lambda t: F.concat(*[runs_of(t, k) for k in sizes]))).alias("r")) if sizes else toks.select("id", F.lit(None).cast("struct<at:int,n:int,run:string>").alias("r")).limit(0)
    hits = runs.select("id", "r.at", "r.n", "r.run").join(forms, "run")
    spans = hits.groupBy("id").agg(F.array_sort(F.collect_set(F.struct((-F.col("len")).alias("o"), "at", "n", "entry", "event", "brand"))).alias("s"))

    def keep(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda y: (y["at"] < x["at"] + x["n"]) & (x["at"] < y["at"] + y["n"]) & ~((y["at"] == x["at"]) & (y["n"] == x["n"])))
        return F.when(clash, acc).otherwise(F.array_append(acc, x))
    kept = F.aggregate("s", F.filter("s", lambda x: F.lit(False)), keep)
    return (spans.select("id", F.explode(kept).alias("k")).groupBy("id", "k.entry").agg(F.min(F.struct("k.at", "k.event", "k.brand")).alias("f"))
            .select("id", "entry", "f.at", "f.event", "f.brand"))


def jn_place_store_rules(posts: DataFrame, stores: DataFrame) -> DataFrame:
    """The registry store of each sale post and how it was decided: the source's field, "at X" in the title, "head to X" in
    the text, the title's start, the only name in it, the text's "at X". Needs posts(id, source, seller, title, text),
    stores(store, names, domains, events, brand, ord)."""
    names = (stores.select(F.col("store").alias("entry"), F.explode("names").alias("name"), F.lit(False).alias("event"), "brand")
             .unionByName(stores.select(F.col("store").alias("entry"), F.explode("events").alias("name"), F.lit(True).alias("event"), "brand")))
    p = posts.withColumns({"_title": F.regexp_replace(straight(F.col("title")), r"(?i)\b(?:free\s+)?(?:shipping|delivery)\s+(?:for|w/|with)\s+(?:amazon\s+)?prime(?:\s+members?)?\b", " "),
                           "_seller": F.when(says(F.trim("seller"), R.DEAL_SITES), "").otherwise(F.coalesce("seller", F.lit("")))})
    phrase = lambda col, rx, prio: F.transform(F.regexp_extract_all(col, F.lit(rx), F.lit(1)), lambda x, i: F.struct(F.lit(prio).alias("p"), i.alias("i"), x.alias("phrase")))
    # each post is searched once; the phrases are written down, since they are looked up several times
    phrases = cut(p.select("id", F.explode(F.concat(phrase(F.col("_title"), R.PLACE, 2), phrase(F.col("_title"), R.SENT_TO, 3), phrase(straight(F.col("text")), R.SENT_TO, 4),
                                                    phrase(straight(F.col("text")), R.PLACE, 7))).alias("f")).select("id", "f.p", "f.i", "f.phrase"))
    # what a phrase means is found once per distinct phrase: a shop in it, else what its words stand for
    distinct = phrases.select("phrase").distinct()
    inside = (jn_dictionary_scan(distinct.select(F.col("phrase").alias("id"), F.col("phrase").alias("text")), names).where("NOT brand")
              .groupBy("id").agg(F.min_by("entry", "at").alias("store")).select(F.col("id").alias("phrase"), "store"))
    meant = (jn_seller_store(distinct.withColumnRenamed("phrase", "seller"), stores).select(F.col("seller").alias("phrase"), F.col("store").alias("named"))
             .join(inside, "phrase", "full").select("phrase", F.coalesce("store", "named").alias("store")))
    by_phrase = phrases.join(meant, "phrase").select("id", "p", "i", "store")
    field = p.where("_seller <> ''").join(jn_seller_store(p.select(F.col("_seller").alias("seller")), stores).withColumnRenamed("seller", "_seller"), "_seller")
    by_field = field.select("id", F.lit(1).alias("p"), F.lit(0).alias("i"), "store")
    named = jn_dictionary_scan(p.select("id", F.col("_title").alias("text")), names)
    per_post = named.groupBy("id").agg(F.count_if(~F.col("brand")).alias("shops"), F.count("*").alias("all"), F.min(F.when(~F.col("brand"), F.struct("at", "entry"))).alias("shop"),
                                       F.min(F.struct("at", "entry", "brand")).alias("first"))
    by_name = per_post.select("id", F.when((F.col("first.at") == 0) & ~F.col("first.brand"), F.struct(F.lit(5).alias("p"), F.col("first.entry").alias("store")))
                              .when(F.col("shops") == 1, F.struct(F.lit(6).alias("p"), F.col("shop.entry").alias("store")))
                              .when((F.col("shops") == 0) & (F.col("all") == 1), F.struct(F.lit(8).alias("p"), F.col("first.entry").alias("store"))).alias("c"))
    cands = by_phrase.unionByName(by_field).unionByName(by_name.where("c IS NOT NULL").select("id", "c.p", F.lit(0).alias("i"), "c.store"))
    best = cands.groupBy("id").agg(F.min(F.struct("p", "i", "store")).alias("b"))
    how = F.element_at(F.array(*[F.lit(x) for x in ("the store field", "the title says where", "the title says where", "the post says where", "the title starts with it",
                                                    "the title names it", "the post says where", "the title names it")]), F.col("b.p"))
    df = posts.join(best, "id", "left")
    # a retailer the source names and the registry lacks is not looked for elsewhere
    unknown = (F.col("source") == "dealnews") & (F.coalesce("seller", F.lit("")) != "") & ~says(F.trim("seller"), R.DEAL_SITES) & (F.coalesce(F.col("b.p"), F.lit(9)) != 1)
    return df.withColumns({"store": F.when(~unknown, F.col("b.store")), "store_how": F.when(~unknown & F.col("b").isNotNull(), how)}).drop("b")


def jn_same_name_site(merchants: DataFrame, sites: DataFrame) -> DataFrame:
    """Merchants without mapped places, with the shop site of the same name, if there is one. Needs merchants(merchant),
    sites(host, name)."""
    s = sites.select(fn_norm(F.col("name")).alias("key"), "host").where("key <> ''").groupBy("key").agg(F.min("host").alias("host"))
    return merchants.withColumn("key", fn_norm(F.col("merchant"))).join(s, "key", "left").drop("key")


def jn_asof_last_good_read(specs: DataFrame, reads: DataFrame, now: Column, live_days: dict[str, int] | None = None) -> DataFrame:
    """Whether evidence is live at `now`: the newest attempt decides. Read without the words: ended. A company's own page with the words is
    live within its days of the read, and an unreadable one stands by its latest good read. A list or an article is as old as its page
    says: live within its days of the page's date (of the read, else of the latest good read that has one); without a date its age is unknown. Needs
    specs(key, kind), reads(key, checked_at, found (null: unreadable)); page_date (a date), where reads have it."""
    days = live_days or {"official": 7, "rewards": 7, "list": 45, "article": 180}
    dated = F.col("page_date") if "page_date" in reads.columns else F.lit(None).cast("date")
    past = reads.withColumn("_date", dated).where(F.col("checked_at") <= now).groupBy("key").agg(
        F.max(F.struct("checked_at", F.when(F.col("found"), 2).when(F.col("found").isNull(), 1).otherwise(0).alias("got"), "_date")).alias("last"),
        F.max(F.when(F.col("found"), F.col("checked_at"))).alias("last_hit"), F.max(F.when(F.col("found") & F.col("_date").isNotNull(), F.struct("checked_at", "_date"))).alias("hit"))
    limit = F.lit(None).cast("int")
    for kind, n in days.items():
        limit = F.when(F.col("kind") == kind, F.lit(n)).otherwise(limit)
    df = specs.join(past, "key", "left")
    got, by_page = F.col("last.got"), F.col("kind").isin("list", "article") if "page_date" in reads.columns else F.lit(False)
    fresh = seconds_between(F.col("last_hit"), now) / 86400 <= limit
    said = F.coalesce("last._date", "hit._date")
    status = (F.when(F.col("last").isNull(), "never read").when(got == 0, "the page no longer says this")
              .when(by_page & (got == 1), "unreadable").when(by_page & said.isNull(), "the page carries no date").when(by_page & (F.datediff(F.to_date(now), said) <= limit), "confirmed").when(by_page, "too old")
              .when((got == 2) & fresh, "confirmed").when(got == 2, "too old").when(fresh, "last confirmed earlier").otherwise("unreadable"))
    return df.withColumns({"status": status, "live": status.isin("confirmed", "last confirmed earlier"), "checked_at": F.col("last_hit")}).drop("last", "hit", "last_hit")


def jn_venue_rules(pois: DataFrame, rules: DataFrame) -> DataFrame:
    """The venue each place belongs to: its brand is listed, or its name starts with one of the venue's names, and its type
    is one the venue allows; the first rule that fits. Needs pois(ref, name, brand, type), rules(ord, venue, names, brands,
    types (empty: any))."""
    p = pois.select("ref", "type", fn_fold(F.col("name")).alias("_n"), fn_fold(F.col("brand")).alias("_b"))
    allowed = rules.select("ord", "venue", "types", "names", "brands")
    by_brand = allowed.select("ord", "venue", "types", F.explode("brands").alias("b")).select("ord", "venue", "types", fn_fold(F.col("b")).alias("_b")).where("_b <> ''")
    by_name = allowed.select("ord", "venue", "types", F.explode("names").alias("n")).select("ord", "venue", "types", fn_fold(F.col("n")).alias("_p")).where("_p <> ''")
    # a name is looked up by its beginnings of the lengths that rules have
    lengths = by_name.agg(F.collect_set(F.length("_p")).alias("_lengths"))
    starts = p.select("ref", "type", "_n").crossJoin(F.broadcast(lengths)).select("ref", "type", "_n", F.explode("_lengths").alias("_k")).where(F.length("_n") >= F.col("_k")).select("ref", "type", F.substring("_n", F.lit(1), F.col("_k")).alias("_p"))
    hits = p.join(by_brand, "_b").select("ref", "type", "ord", "venue", "types").unionByName(starts.join(by_name, "_p").select("ref", "type", "ord", "venue", "types"))
    fits = (F.size("types") == 0) | F.array_contains("types", F.col("type"))
    best = hits.where(fits).groupBy("ref").agg(F.min(F.struct("ord", "venue")).alias("b")).select("ref", "b.venue")
    # as many rows as there are places, which a small file may hold: never sent to all by its planned size
    return pois.join(best.hint("merge"), "ref", "left")


def jn_merge_posts(posts: DataFrame) -> DataFrame:
    """One row per post id: the first one read, with every feed and feed category it came with in the order they were read.
    Needs id, ord (plan order), feeds and feed_categories arrays. Feeds are made distinct before they are gathered, so a
    post seen a million times gathers as many names as there are feeds."""
    rest = [c for c in posts.columns if c not in ("id", "ord", "feeds", "feed_categories")]
    first = posts.groupBy("id").agg(F.min_by(F.struct(*rest), F.col("ord")).alias("p"), F.min("ord").alias("ord"))

    def union(col: str) -> DataFrame:
        e = posts.select("id", "ord", F.posexplode(col).alias("i", "v")).groupBy("id", "v").agg(F.min(F.struct("ord", "i")).alias("o"))
        s = e.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("o", "v"))).alias("s"))
        return s.select("id", F.col("s.v").alias(col))
    df = first.join(union("feeds"), "id", "left").join(union("feed_categories"), "id", "left")
    none = F.array().cast("array<string>")
    return df.select("id", "p.*", "ord", F.coalesce("feeds", none).alias("feeds"), F.coalesce("feed_categories", none).alias("feed_categories"))


def jn_answer_key(key: DataFrame, results: DataFrame) -> DataFrame:
    """Whether each expected offer is among the results: its place, a shared day and something of the offer must match.
    Needs key(id, chain, days, tokens), results(chain, days, tokens). Only existence is asked, so nothing is paired."""
    token = results.select("chain", F.explode("days").alias("day"), "tokens").select("chain", "day", F.explode("tokens").alias("token")).distinct()
    k = key.select("id", "chain", F.explode("days").alias("day"), "tokens")
    hit = (k.select("id", "chain", "day", F.explode("tokens").alias("token")).join(token, ["chain", "day", "token"]).select("id", "token").distinct()
           .groupBy("id").agg(F.count("*").alias("shared")))
    chains = results.select("chain").distinct().withColumn("_has", F.lit(True))
    df = key.join(hit, "id", "left").join(chains, "chain", "left")
    return df.withColumns({"verdict": F.when(F.col("shared") > 0, "pass").otherwise("fail"), "shared": F.coalesce("shared", F.lit(0)),
                           "why": F.when(F.col("shared") > 0, "").when(F.col("_has"), "this place is known, but not this offer or not on these days")
                           .otherwise("this place is not in the results")}).drop("_has")


def jn_cross_source(offers: DataFrame, need: int = 2) -> DataFrame:
    """What other sources say of each offer at the same chain on the same day: `agrees` (a shared word and amount), else
    `conflicts` (`need` words shared, other amounts), else nothing. Needs id, chain, day, source, tokens, amounts (arrays of
    a sentence's words, so short). Per key only the span of sources is kept, which tells whether another one is behind it."""
    def other(keys: DataFrame) -> DataFrame:
        k = [c for c in keys.columns if c not in ("id", "source")]
        span = keys.groupBy(*k).agg(F.min("source").alias("_lo"), F.max("source").alias("_hi"))
        return keys.join(span, k).where((F.col("_lo") != F.col("source")) | (F.col("_hi") != F.col("source"))).select("id").distinct()
    e = offers.select("id", "chain", "day", "source", "tokens", "amounts")
    agree = other(e.withColumn("token", F.explode("tokens")).withColumn("amount", F.explode("amounts")).select("id", "source", "chain", "day", "token", "amount"))
    ts = F.array_sort(F.array_distinct("tokens"))
    combos = ts if need == 1 else F.flatten(F.transform(ts, lambda a: F.transform(F.filter(ts, lambda b: b > a), lambda b: F.concat(a, F.lit("|"), b))))
    same = other(e.where(F.size("amounts") > 0).withColumn("words", F.explode(combos)).select("id", "source", "chain", "day", "words"))
    df = offers.join(agree.withColumn("_a", F.lit(True)), "id", "left").join(same.withColumn("_c", F.lit(True)), "id", "left")
    return df.withColumn("cross", F.when(F.col("_a"), "agrees").when(F.col("_c"), "conflicts").otherwise("not covered")).drop("_a", "_c")


def jn_full_diff(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Two results compared by key: what is missing, what is extra, and which fields differ. Equal rows are left out."""
    x = a.select(key, F.struct(*columns).alias("_a"))
    y = b.select(key, F.struct(*columns).alias("_b"))
    fields = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]))
    df = x.join(y, key, "full")
    df = df.withColumns({"diff": F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.size(fields) > 0, "differs"),
                         "fields": F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), fields).otherwise(F.array().cast("array<string>"))})
    return df.where("diff IS NOT NULL").select(key, "diff", "fields")


def jn_merge_labels(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Pending verdicts decided by outside labels: pass when the category shown is among them. Needs verdicts(test, verdict,
    shown), labels(test, categories)."""
    df = verdicts.join(labels.select("test", "categories"), "test", "left")
    decided = (F.col("verdict") == "pending") & F.col("categories").isNotNull()
    return df.withColumn("verdict", F.when(decided, F.when(F.array_contains("categories", F.col("shown")), "pass").otherwise("fail")).otherwise(F.col("verdict"))).drop("categories")


def jn_dims_used(stores: DataFrame, offers: DataFrame) -> DataFrame:
    """The stores the shown offers refer to."""
    return stores.join(offers.select("store").distinct(), "store", "left_semi")


def jn_name_claims(claims: DataFrame) -> DataFrame:
    """A name several chains claim goes to the strong claim made last, else to the chain with the most places, the first of
    equals. Needs name, chain, strong, places, ord."""
    k = claims.withColumn("key", fn_fold(F.col("name"))).where(F.length("key") >= 2)
    order = F.struct(F.col("strong").cast("int").alias("s"), F.when(F.col("strong"), F.col("ord")).otherwise(F.col("places")).alias("p"), (-F.col("ord")).alias("o"))
    return k.groupBy("key").agg(F.max_by("chain", order).alias("chain"), F.count_distinct("chain").alias("claims"))
