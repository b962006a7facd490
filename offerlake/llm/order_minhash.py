"""Order MinHash fingerprints, which feel the order of a text and so its edit distance, not only its set of words.

A text's tokens are its words; letters of scripts written without spaces are tokens of their own. Its k-mers are runs of `k` tokens, each
numbered by how often it has occurred before, so that repeats are items of their own. An item's hash deals it to one of `slots` slots; in each slot the
`per_slot` items of least hash are taken, put back into text order and hashed as a tuple. That is the slot's element. The likeness of two
fingerprints is the share of equal elements among the slots that are filled in either.

All of it is array functions inside the row: nothing is exploded, no k-mer is shuffled. Items are packed into one long (hash bits above,
the position in the low 31 bits, which is more than a text can have), so sorting them is sorting longs.

Defined results: rows without an id come first in the order of ids; rows of one id are ordered by their text's hash; a table of one row
is its own next; null and blank texts have no items and an empty slot everywhere; two such fingerprints are alike (1.0), one such and
another are not (0.0); fewer tokens than `k` make one k-mer of all tokens; equal texts have equal fingerprints whatever their rows. Extra
columns, also of the names made here, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlake.functions.amounts import bind

from .catalog import query, table
from .ranges import range_of

LOW = (1 << 31) - 1
# Scripts without spaces between words.
ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
BETWEEN = rf"\s+|(?<=[{ALONE}])|(?=[{ALONE}])"


def tokens(text: Column) -> Column:
    return F.array_remove(F.when(text.rlike(f"[{ALONE}]"), F.split(text, BETWEEN)).otherwise(F.split(text, r"\s+")), "")


def starts(s: Column, group) -> Column:
    """Where runs of equal `group` begin in the sorted array `s`."""
    return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (group(F.get(s, j - 1)) != group(F.get(s, j))))


def packed(high: Column, position: Column) -> Column:
    return F.shiftleft(high, 31).bitwiseOR(position)


def position(item: Column) -> Column:
    return item.bitwiseAND(F.lit(LOW))


def kmer_items(w: Column, k: int) -> Column:
    """Sorted longs: 32 bits of a k-mer's hash, then its place in the text."""
    n = F.greatest(F.size(w) - (k - 1), F.lit(1))
    one = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
    return F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda i: packed(F.shiftrightunsigned(one(i), 32), i.cast("bigint"))))


def numbered(s: Column, slots: int) -> Column:
    """Sorted longs: slot, the rest of the hash of (k-mer, occurrence number), place."""
    high = lambda x: F.shiftrightunsigned(x, 31)
    number = lambda at: F.flatten(F.transform(at, lambda j, r: F.sequence(F.lit(0), F.coalesce(F.get(at, r + 1), F.size(s)) - j - 1)))
    shift = 32 - (slots.bit_length() - 1)
    item = lambda x, occ: F.shiftrightunsigned(F.xxhash64(high(x), occ), 32)
    with_slot = lambda h: F.shiftleft(F.pmod(h, F.lit(slots)), shift).bitwiseOR(F.shiftrightunsigned(h, 32 - shift))
    return bind(bind(starts(s, high), number), lambda occ: F.sort_array(F.transform(s, lambda x, i: packed(with_slot(item(x, F.get(occ, i))), position(x)))))


def elements(items: Column, slots: int, per_slot: int) -> Column:
    """(slot, element) of the filled slots: the hash of the slot's least items in text order."""
    shift = 31 + 32 - (slots.bit_length() - 1)
    slot = lambda x: F.shiftrightunsigned(x, shift)
    least = lambda j: F.filter(F.slice(items, j + 1, per_slot), lambda x: slot(x) == slot(F.get(items, j)))
    in_order = lambda xs: F.sort_array(F.transform(xs, lambda x: F.struct(position(x).alias("at"), F.shiftrightunsigned(x, 31).alias("h"))))
    tuple_of = lambda xs: F.reduce(in_order(xs), F.lit(42).cast("bigint"), lambda acc, x: F.xxhash64(acc, x["h"]))
    return bind(starts(items, slot), lambda at: F.transform(at, lambda j: F.struct(slot(F.get(items, j)).alias("slot"), tuple_of(least(j)).alias("element"))))


def order_minhash(text: Column, k: int = 3, slots: int = 64, per_slot: int = 2) -> Column:
    """The fingerprint: for each slot 8 hex digits of its element, or 8 dots if it is empty. `slots` is a power of two."""
    if slots & (slots - 1):
        raise ValueError("slots must be a power of two")
    some = lambda w: bind(kmer_items(w, k), lambda s: bind(numbered(s, slots), lambda items: elements(items, slots, per_slot)))
    hexed = lambda x: F.lower(F.substring(F.lpad(F.hex(x["element"]), 16, "0"), 9, 8))
    gap = lambda a, b: F.repeat(F.lit("." * 8), (b - a - 1).cast("int"))
    before = lambda e, i: F.coalesce(F.get(e, i - 1)["slot"], F.lit(-1).cast("bigint"))
    filled = lambda e: F.concat(F.array_join(F.transform(e, lambda x, i: F.concat(gap(before(e, i), x["slot"]), hexed(x))), ""),
                                gap(F.element_at(e, -1)["slot"], F.lit(slots)))
    return bind(tokens(F.coalesce(text, F.lit(""))), lambda w: F.when(F.size(w) == 0, F.lit("." * 8 * slots)).otherwise(bind(some(w), filled)))


def likeness(a: Column, b: Column, slots: int = 64) -> Column:
    """Share of equal elements among the slots filled in either fingerprint; 1.0 if none is."""
    cut_at = lambda c: F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.substring(c, i * 8 + 1, F.lit(8)))
    both = F.zip_with(cut_at(a), cut_at(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    used = F.filter(both, lambda p: (p["x"] != "." * 8) | (p["y"] != "." * 8))
    return bind(used, lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.filter(u, lambda p: p["x"] == p["y"])) / F.size(u)))


# ---- neighbours in the order of ids --------------------------------------------------------------------------------------------------

def with_next(docs: DataFrame, doc_id: str = "doc_id", carried: tuple[str, ...] = ("text",), runs: int | None = None) -> DataFrame:
    """`docs` with `next_<column>` of the next row by id (rows of one id: by the carried columns' hash), the first after the last.

    Ids are cut into `runs` runs at quantiles that are ids of the table. The first row of a run also goes to the end of the run before
    (of the first run: to the last), so each run has all neighbours it needs: one shuffle by run, no window over the whole table."""
    spark = docs.sparkSession
    runs = runs or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_id = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-1 << 63))
    ids = docs.select(sort_id.alias("id"))
    found = ids.agg(F.min("id").alias("least"), F.percentile_approx("id", [i / runs for i in range(1, runs)] or [0.5], 100 * runs).alias("cuts")).first()
    if found.least is None:
        return docs.select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in carried])
    cuts = sorted({found.least, *(found.cuts if runs > 1 else [])})
    run = range_of(F.col("_id"), cuts) - 1
    is_cut = range_of(F.col("_id"), cuts) != range_of(F.col("_id"), [min(x + 1, (1 << 63) - 1) for x in cuts])
    placed = docs.withColumn("_id", sort_id).withColumn("_run", run).withColumn(
        "_to", F.when(is_cut, F.array(F.struct(F.col("_run").alias("run"), F.lit(False).alias("halo")), F.struct(F.pmod(F.col("_run") - 1, F.lit(len(cuts))).alias("run"), F.lit(True).alias("halo"))))
        .otherwise(F.array(F.struct(F.col("_run").alias("run"), F.lit(False).alias("halo")))))
    placed = placed.select("*", F.inline("_to")).drop("_to", "_run")
    order = Window.partitionBy("run").orderBy("halo", "_id", F.xxhash64(*carried))
    out = placed.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where("not halo")
    return out.drop("_id", "run", "halo")


def edit_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 3, slots: int = 64, per_slot: int = 2) -> DataFrame:
    """The fingerprint of every text, of the text whose last half is replaced by the start of the next document, and the likeness to
    that and to the next document."""
    mark = lambda c: order_minhash(F.col(c), k, slots, per_slot)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("fingerprint", mark("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    texts = with_next(plain, carried=("text", "fingerprint")).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), "fingerprint", "next_fingerprint",
        F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    marked = texts.select("*", F.sha2("edited", 256).alias("edited_sha256"), mark("edited").alias("edited_fingerprint"))
    return marked.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                         likeness(F.col("fingerprint"), F.col("edited_fingerprint"), slots).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint"), slots).alias("near_next"))


@query("op7_order_minhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(table(spark, sf_dir, "documents"))
