"""Categories of items, posts and sales, each with the rule that gave them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fn_norm, fn_words
from ..functions.amounts import bind
from ..functions.text import fn_clean, straight
from ..rules import categories as K
from ..rules import wordings as R
from .sales import is_store_event
from .wordwork import says, without

Rules = Sequence[tuple[str, str, Sequence[str]]]


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _hits(text: Column, rules: Rules) -> Column:
    return F.array_compact(F.array(*[F.when(says(text, rx), F.struct(F.lit(name).alias("name"), strings(cats).alias("cats"))) for name, rx, cats in rules]))


def from_text(text: Column, rules: Rules) -> Column:
    """struct(categories, rule) from a text's words: what stands before its ingredients first, then all of it. Bare pet and
    apparel words count only where no rule does."""
    def hits(head: Column) -> Column:
        # all of the text is asked only where something was cut off and the rest names nothing
        return bind(_hits(head, rules), lambda h: F.when((F.size(h) > 0) | (head == text), h).otherwise(_hits(text, rules)))

    def decide(h: Column) -> Column:
        first = F.get(h, 0)["cats"]
        strong = F.get(F.filter(h, lambda x: x["name"].isin(*K.DOMINANT)), 0)
        found = F.flatten(F.transform(h, lambda x: x["cats"]))
        pairs = F.array_compact(F.array(*[F.when(F.array_contains(first, a) & F.array_contains(found, b), F.lit(b)) for a, b in K.PAIRINGS],
                                        *[F.when(F.array_contains(first, b) & F.array_contains(found, a), F.lit(a)) for a, b in K.PAIRINGS]))
        names = F.array_join(F.slice(F.transform(h, lambda x: x["name"]), 1, 2), "+")
        s = lambda cats, rule: F.struct(cats.alias("categories"), rule.alias("rule"))               # noqa: E731
        return (F.when(strong.isNotNull(), s(strong["cats"], F.concat(F.lit("keywords:"), strong["name"])))
                .when(F.size(h) > 0, s(F.array_distinct(F.concat(first, pairs)), F.concat(F.lit("keywords:"), names)))
                .when(says(text, K.PET_WORD), s(strings(["pets"]), F.lit("keywords:pet-word")))
                .when(says(text, K.APPAREL_CUE), s(strings(["fashion"]), F.lit("keywords:apparel-cue")))
                .otherwise(s(strings([]), F.lit(""))))
    return bind(bind(F.regexp_replace(text, K.INGREDIENTS, ""), hits), decide)


def text_categories(text: Column, rules: Rules) -> Column:
    """Every category a text's words name, in rule order."""
    return F.array_distinct(F.flatten(F.transform(_hits(text, rules), lambda x: x["cats"])))


def from_department(name: Column) -> Column:
    found = F.array_distinct(F.array_compact(F.array(*[F.when(says(name, rf"\b{w}(?:'s)?\b"), F.lit(cat)) for w, cat in K.DEPARTMENTS])))
    return bind(found, lambda x: F.struct(x.alias("categories"), F.concat(F.lit("department:"), F.array_join(x, "+")).alias("rule")))


def _learned(df: DataFrame, shares: DataFrame | None) -> DataFrame:
    """Adds `_learned`: struct(categories, rule) of the best-attested learned word of `_words`, limited to `sells`. The word
    table is joined, so it may be any size; a frequent word's side is split by AQE."""
    if shares is None:
        return df.withColumn("_learned", F.lit(None).cast("struct<categories:array<string>,rule:string>"))
    w = df.select("id", "sells", F.explode("_words").alias("word")).join(shares, "word")
    cats = F.when(F.size("sells") > 0, F.array_intersect("categories", "sells")).otherwise(F.col("categories"))
    best = (w.withColumn("categories", cats).where(F.size("categories") > 0).groupBy("id").agg(F.max(F.struct("total", "word", "categories")).alias("b"))
            .select("id", F.struct(F.col("b.categories").alias("categories"),
                                   F.concat(F.lit("learned:"), "b.word", F.lit(" ("), F.col("b.total").cast("string"), F.lit(" labelled)")).alias("rule")).alias("_learned")))
    return df.join(best, "id", "left")


def _some(x: Column) -> Column:
    return F.size(x["categories"]) > 0


def job_classify_items(items: DataFrame, taxonomy: DataFrame, rules: Rules = K.STARTER_RULES, shares: DataFrame | None = None,
                       overrides: Sequence[tuple[str, Sequence[str]]] = K.STARTER_OVERRIDES) -> DataFrame:
    """Categories of ad items: a specialty store's line, overrides, the source's taxonomy, keywords, learned words, the
    store's line; kept to what the store sells. Needs items(id, title, brand, l1, l2, prior, sells arrays, exclusive,
    food), taxonomy(l1, l2, categories) with a null l2 for the whole of l1."""
    c = F.col
    t2 = taxonomy.where("l2 IS NOT NULL").select("l1", "l2", F.col("categories").alias("_c2"))
    t1 = taxonomy.where("l2 IS NULL").select("l1", F.col("categories").alias("_c1"))
    text = F.trim(F.concat_ws(" ", F.nullif(fn_clean(c("brand")), F.lit("")), fn_clean(c("title"))))
    df = items.join(t2, ["l1", "l2"], "left").join(t1, "l1", "left")
    label = F.when(F.coalesce(c("l2"), F.lit("")) != "", F.concat("l1", F.lit(" > "), "l2")).otherwise(c("l1"))
    s = lambda cats, rule: F.struct(cats.cast("array<string>").alias("categories"), rule.alias("rule"))     # noqa: E731
    # a store that sells no food: a food label is the source's mistake
    df = df.withColumns({"_text": text, "_words": fn_words(c("brand"), c("title")),
                         "_food": (c("l1") == "Food, Beverages & Tobacco") & ~c("food")})
    df = _learned(df, shares)
    tax = F.when(~F.coalesce(c("_food"), F.lit(False)), F.coalesce("_c2", "_c1"))
    athletic = F.array_contains("prior", "sports") & (F.size(F.array_except(tax, strings(["fashion"]))) == 0)
    by_tax = F.when(F.size(tax) > 0, s(F.when(athletic, F.array_union(tax, strings(["sports"]))).otherwise(tax), F.concat(F.lit("taxonomy:"), label)))
    by_override = F.when(F.lit(False), s(strings([]), F.lit("")))
    for rx, cats in overrides:
        by_override = by_override.when(says(c("_text"), rx), s(strings(cats), F.lit(f"override:{cats[0]}")))
    # the words are read only where what comes before them does not decide
    df = df.withColumn("_first", F.coalesce(F.when(c("exclusive") & (F.size("prior") > 0), s(c("prior"), F.lit("merchant:specialty store"))), by_override))
    df = df.withColumn("_kw", F.when(c("_first").isNull() & (F.coalesce(c("_food"), F.lit(False)) | by_tax.isNull()), from_text(c("_text"), rules)))
    agreed = F.when(c("_food") & F.array_contains(c("_kw.categories"), "grocery"), s(strings(["grocery"]), F.concat(F.lit("taxonomy:"), label, F.lit("+keywords agree"))))
    got = F.coalesce(c("_first"), agreed, by_tax,
                     F.when(_some(c("_kw")), c("_kw")), c("_learned"), F.when(F.size("prior") > 0, s(c("prior"), F.lit("merchant"))),
                     s(strings([]), F.when(label.isNotNull(), F.concat(F.lit("taxonomy:"), label)).otherwise("unclassified")))
    df = df.withColumn("_got", got)
    keep = F.array_intersect("_got.categories", "sells")
    by_words = F.slice(F.array_intersect(text_categories(c("_text"), rules), c("sells")), 1, 1)
    line = F.array_intersect("prior", "sells")
    limited = (F.when((F.size("sells") == 0) | ~_some(c("_got")), c("_got")).when(F.size(keep) > 0, s(keep, c("_got.rule")))
               .when(F.size(by_words) > 0, s(by_words, F.concat("_got.rule", F.lit("+not sold here, so keywords"))))
               .otherwise(s(line, F.concat("_got.rule", F.lit("+not sold here"), F.when(F.size(line) > 0, ", so the store's line").otherwise("")))))
    return df.withColumn("_out", limited).select(*items.columns, F.col("_out.categories").alias("categories"), F.col("_out.rule").alias("rule"))


def job_classify_posts(posts: DataFrame, leaves: DataFrame, rules: Rules = K.STARTER_RULES, shares: DataFrame | None = None) -> DataFrame:
    """Categories of posts: the source's own leaf, narrowed by the feed; the title's keywords; the feed; the category's
    words; learned words within what the seller sells. Needs posts(id, source, title, category, feeds, feed_categories,
    sells), leaves(leaf (normalised), categories)."""
    c = F.col
    s = lambda cats, rule: F.struct(cats.cast("array<string>").alias("categories"), rule.alias("rule"))     # noqa: E731
    df = (posts.withColumns({"leaf": fn_norm(c("category")), "_words": fn_words(c("title"))})
          .join(leaves.select("leaf", F.col("categories").alias("_leaf")), "leaf", "left"))
    df = _learned(df, shares)
    feed, narrowed = c("feed_categories"), F.array_intersect("_leaf", "feed_categories")
    own = F.when(c("source") == "dealnews", F.when((F.size("_leaf") > 1) & (F.size(narrowed) > 0), s(narrowed, F.concat(F.lit("dealnews:"), "category")))
                 .when(F.size("_leaf") > 0, s(c("_leaf"), F.concat(F.lit("dealnews:"), "category")))
                 .when((c("category") != "") & c("_leaf").isNull() & (F.size(feed) > 0), s(feed, F.concat(F.lit("dealnews-feed:"), F.array_join(feed, ",")))))
    # a title is read only where the source's own leaf does not decide, a category only where its words may
    df = df.withColumn("_own", own)
    df = df.withColumn("_kw", F.when(c("_own").isNull(), from_text(c("title"), rules)))
    by_words = bind(from_text(c("category"), rules), lambda x: F.when(_some(x), s(x["categories"], F.concat(F.lit("dealcatcher:"), "category"))))
    hint = F.when((c("source") == "hip2save") & _some(c("_kw")), s(c("_kw.categories"), F.concat("_kw.rule", F.lit("+feed hint"))))
    more = F.slice(F.array_except("_kw.categories", feed), 1, 1)
    by_feed = F.when(F.size(feed) > 0, s(F.concat(feed, more), F.concat(F.lit("feed:"), F.coalesce(F.get("feeds", 0), F.lit("")),
                                                                     F.when(F.size(more) > 0, F.concat(F.lit("+"), "_kw.rule")).otherwise(""))))
    by_cat = F.when(c("source") == "dealcatcher", by_words)
    got = F.coalesce(c("_own"), hint, by_feed, by_cat, F.when(_some(c("_kw")), c("_kw")), c("_learned"), c("_kw"))
    return df.withColumn("_out", got).select(*posts.columns, c("_out.categories").alias("categories"), c("_out.rule").alias("rule"))


def job_classify_sales(sales: DataFrame, rules: Rules = K.STARTER_RULES, online: Sequence[str] = tuple(K.ONLINE)) -> DataFrame:
    """Categories a sale counts for. Needs the post's categories and rule (job_classify_posts), title, text, category,
    name, sitewide, store_event, and the store's `store` and sells. A store-wide sale counts for the goods its post names,
    or for what the store sells; any other sale for what it is about."""
    c = F.col
    shop = strings(list(online))
    s = lambda cats, rule: F.struct(cats.cast("array<string>").alias("categories"), rule.alias("rule"))     # noqa: E731
    main = without(straight(c("title")), R.ASIDE, "")
    post = s(c("categories"), c("rule"))
    by_cat = bind(from_text(c("category"), rules), lambda x: F.when(_some(x), s(x["categories"], F.concat(F.lit("category words: "), "category"))))
    by_dept = bind(from_department(c("name")), lambda x: F.when(_some(x), x))
    ordered = lambda xs: F.array_intersect(shop, xs)                                                # noqa: E731
    in_store, sells = F.coalesce(c("store"), F.lit("")) != "", F.size("sells") > 0
    event = in_store & (c("sitewide") | c("store_event"))
    # the category and the name are read only where the post's own categories do not decide
    df = sales.withColumns({"_main": main, "_cls": F.coalesce(F.when(F.size("categories") > 0, post), by_cat, F.when(~c("store_event"), by_dept), s(strings([]), F.lit("")))})
    all_named = text_categories(c("_main"), rules)
    df = df.withColumn("_found", F.when(c("_cls.rule").startswith("keywords"), F.array_union(F.array_intersect("_cls.categories", shop), F.array_intersect(all_named, shop)))
                       .otherwise(F.array_intersect("_cls.categories", shop)))
    own = c("_cls.rule").startswith("dealnews:") | c("_cls.rule").startswith("category words")
    named = F.array_intersect(text_categories(F.concat_ws(" ", "_main", "text"), rules), shop)
    # what the post names counts for a store-wide event alone
    df = df.withColumn("_evidence", F.when(event, ordered(F.array_union(named, F.when(own, c("_found")).otherwise(strings([]))))))
    line = F.slice("sells", 1, F.when(F.size("sells") >= 4, 2).otherwise(1))
    kept_event, kept = F.array_intersect("_evidence", "sells"), F.when(sells, F.array_intersect("_found", "sells")).otherwise(c("_found"))
    named_how = F.lit("a store-wide event: the goods its post names")
    small = in_store & sells & (F.size("sells") <= 3)
    got = (F.when(event & sells & ~c("sitewide") & (F.size(kept_event) > 0), s(kept_event, named_how))
           .when(event & sells & c("sitewide"), s(c("sells"), F.lit("sitewide: what the store sells")))
           .when(event & sells, s(line, F.lit("a store-wide event: the store's main line")))
           .when(event & (F.size("_evidence") > 0), s(c("_evidence"), named_how))
           .when(event, s(shop, F.lit("a store-wide event at a store that sells everything")))
           .when((F.size("_found") > 0) & (F.size(kept) == 0) & small, s(F.slice("sells", 1, 1), F.lit("the store's own line")))
           .when(F.size("_found") > 0, s(ordered(F.when(F.size(kept) > 0, kept).otherwise(c("_found"))), c("_cls.rule")))
           .when(small, s(F.slice("sells", 1, 1), F.lit("the store's own line"))).otherwise(s(strings([]), F.lit(""))))
    return df.withColumn("_out", got).select(*[x for x in sales.columns if x not in ("categories", "rule")], c("_out.categories").alias("categories"),
                                             c("_out.rule").alias("rule"))


def job_label_examples(classified: DataFrame) -> DataFrame:
    """Rows whose categories are the source's own label, as examples to learn words from: key, source, words, categories,
    one per distinct item. A rule's guess is never learned from. Needs key, source, title, brand, l1, categories, rule."""
    r = F.col("rule")
    own = ((F.coalesce(F.col("l1"), F.lit("")) != "") & (r.startswith("taxonomy:") | r.startswith("override:"))) | (r == "merchant:specialty store") | r.startswith("dealnews:")
    guess = r.contains("keywords") | r.contains("not sold here") | r.contains("ignored")
    ex = classified.where(own & ~guess).select(F.concat_ws("|", "source", "key").alias("key"), "source", fn_words(F.col("brand"), F.col("title")).alias("words"), "categories")
    ex = ex.where((F.size("words") > 0) & (F.size("categories") > 0))
    return ex.groupBy("key").agg(F.min(F.struct("source", "words", "categories")).alias("e")).select("key", "e.*")


__all__ = ["from_text", "from_department", "text_categories", "job_classify_items", "job_classify_posts", "job_classify_sales", "job_label_examples", "is_store_event"]
