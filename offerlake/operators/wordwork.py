"""Small regex helpers the text jobs share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.amounts import bind, found, general, number, once, rounded
from ..rules import wordings as R
from ..rules.signs import words_in


def ci(pattern: str) -> str:
    return f"(?i){pattern}"


def holds(low: Column, words: Sequence[str]) -> Column:
    """Whether a text in lower case holds one of some words."""
    some = low.contains(words[0])
    for w in words[1:]:
        some = some | low.contains(w)
    return some


def may_match(text: Column, pattern: str, low: Column | None = None) -> Column | None:
    """Whether a text holds the sign every match of the pattern has, and one of the words of which it has one, which is far cheaper to see
    than the match; None for a pattern without such. `low` is the text in lower case where that is known."""
    sign, words = R.SIGNS.get(pattern), R.WORDS.get(pattern) or R.MORE_WORDS.get(pattern) or words_in(pattern)
    there = None if sign is None else text.contains(sign)
    if words is None or (sign is not None and list(words) == [sign]):
        return there
    if low is not None or all(w.lower() == w.upper() for w in words):
        said = holds(text if low is None else low, words)
    else:
        said = holds(F.lower(text), words) if len(words) == 1 else bind(F.lower(text), lambda x: holds(x, words))
    return said if there is None else there & said


def where_it_may(text: Column, pattern: str, hit, otherwise: Column | None = None) -> Column:
    """`hit(text)` where the pattern may match, `otherwise` (null) where it cannot. The text is worked out once."""
    def read(t: Column) -> Column:
        worth = may_match(t, pattern)
        if worth is None:
            return hit(t)
        return F.when(worth, hit(t)) if otherwise is None else F.when(worth, hit(t)).otherwise(otherwise)
    return once(text, read)


def got(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, letter case aside; null without one."""
    return where_it_may(text, pattern, lambda t: found(t, ci(pattern), group))


def got_number(text: Column, pattern: str, group: int = 1) -> Column:
    return number(got(text, pattern, group))


def says(text: Column, pattern: str) -> Column:
    return once(text, lambda t: said(F.coalesce(t, F.lit("")), pattern))


def said(t: Column, pattern: str, low: Column | None = None) -> Column:
    """`says` of a text that is not null, whose lower case may be known."""
    worth, hit = may_match(t, pattern, low), t.rlike(ci(pattern))
    return hit if worth is None else worth & hit


def each_said(text: Column, patterns: Sequence[str], read) -> Column:
    """`read` of whether a text says each of the patterns; the text and its lower case are worked out once for all of them."""
    return once(F.coalesce(text, F.lit("")), lambda t: bind(F.lower(t), lambda low: read([said(t, p, low) for p in patterns])))


def without_first(text: Column, pattern: str) -> Column:
    """The text with the first match taken out."""
    def read(t: Column) -> Column:
        worth, left = may_match(t, pattern), F.regexp_replace(t, f"(?is)^(.*?)(?:{pattern})", "$1 ")
        return left if worth is None else F.when(worth, left).otherwise(t)
    return once(text, read)


def without(text: Column, pattern: str, instead: str = " ") -> Column:
    def read(t: Column) -> Column:
        worth, left = may_match(t, pattern), F.regexp_replace(t, ci(pattern), instead)
        return left if worth is None else F.when(worth, left).otherwise(t)
    return once(text, read)


def matches(text: Column, pattern: str) -> Column:
    """Every match, as written."""
    return where_it_may(text, pattern, lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(ci(pattern)), F.lit(0)), F.array().cast("array<string>"))


def labels_of(text: Column, table: Sequence[tuple[str, str]], signs: dict[str, Sequence[str]] | None = None) -> Column:
    """The labels whose pattern matches, in the table's order. `signs` has words, in lower case, of which every match of a label's pattern has
    one: the text is searched for that label only where it holds one."""
    if signs is None:
        return each_said(text, [rx for rx, _ in table], lambda said: F.array_compact(F.array(*[F.when(s, F.lit(label)) for s, (_, label) in zip(said, table)])))
    return once(text, lambda t: bind(F.struct(t.alias("t"), F.lower(t).alias("low")), lambda x: F.array_compact(F.array(
        *[F.when(holds(x["low"], signs[label]) & x["t"].rlike(ci(rx)), F.lit(label)) for rx, label in table]))))


def first_label(text: Column, table: Sequence[tuple[str, str]]) -> Column:
    def read(said: list[Column]) -> Column:
        chain = F.when(F.lit(False), F.lit(None).cast("string"))
        for s, (_, label) in zip(said, table):
            chain = chain.when(s, F.lit(label))
        return chain
    return each_said(text, [rx for rx, _ in table], read)


def count_word(word: Column) -> Column:
    w = F.lower(word)
    return F.when(w == "one", 1).when(w == "two", 2).otherwise(w.try_cast("int"))


def read_match(text: Column, pattern: str, read) -> Column:
    """What `read` makes of the first match, null without one. The text is scanned once; the groups are taken from the match
    alone. `read` gets a function of the group's number."""
    return bind(got(text, pattern, 0), lambda m: F.when(m.isNotNull(), read(lambda g: F.nullif(F.regexp_extract(m, ci(pattern), g), F.lit("")))))


def bogo_of(text: Column) -> Column:
    """struct("buy 1 get 1 50% off", 25.0): the label and the percent saved on the whole set; nulls where there is none."""
    def offer(buy: Column, get: Column, off: Column, free: bool) -> Column:
        def say(x: Column) -> Column:
            what = F.concat(general(x["off"]), F.lit("% off"))
            what = F.when(x["off"] == 100, F.lit("free")).otherwise(what) if free else what
            label = F.concat(F.lit("buy "), x["buy"].cast("string"), F.lit(" get "), x["get"].cast("string"), F.lit(" "), what)
            ok = (x["buy"] > 0) & (x["get"] > 0) & (x["off"] > 0) & (x["off"] <= 100)
            return F.struct(F.when(ok, label).alias("label"), F.when(ok, rounded(x["get"] * x["off"] / (x["buy"] + x["get"]), 1)).alias("pct"))
        return bind(F.struct(buy.alias("buy"), get.alias("get"), off.alias("off")), say)

    def kind_off(kind: Column, stated: Column) -> Column:
        k = F.lower(F.coalesce(kind, F.lit("free")))
        return F.when(k == "free", 100.0).when(k.startswith("half"), 50.0).otherwise(stated.try_cast("double"))

    def glued(g) -> Column:
        three = F.length(g(2)) == 3
        return offer(count_word(g(1)), F.when(three, F.substring(g(2), 1, 1).try_cast("int")).otherwise(1),
                     F.when(three, F.substring(g(2), 2, 2).try_cast("double")).otherwise(g(2).try_cast("double")), False)

    def main(g) -> Column:
        # what follows a buy-and-get with no "free" or percent may price the second one: then it is no saving
        priced = g(4).isNull() & g(6).isNotNull()
        off = F.when(~priced, kind_off(g(4), g(5)))
        return offer(count_word(g(1)), F.when(g(3).isNotNull(), 1).otherwise(count_word(g(2))), off, True)

    def read(t: Column) -> Column:
        return bind(read_match(t, R.BOGO_GLUED, glued), lambda x: F.when(x["label"].isNotNull(), x).otherwise(F.coalesce(
            read_match(t, R.BOGO + "(" + R.BOGO_PRICED + ")?", main),
            read_match(t, R.BOGO_WORD, lambda g: offer(F.lit(1), F.lit(1), kind_off(g(1), g(2)), True)))))
    return once(text, lambda t: F.when(says(t, R.BOGO_START), read(t)))


def staged(df, columns: Sequence[str], *stages: dict[str, Column]):
    """Add columns stage by stage and keep only `columns` of them: later stages read earlier ones by name."""
    own = df.columns
    for s in stages:
        df = df.withColumns(s)
    return df.select(*own, *[c for c in columns if c not in own])
