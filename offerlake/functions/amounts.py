"""Money, percents and text of amounts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an amount, with or without thousands separators.
AMOUNT = r"(\d{1,3}(?:,\d{3})+|\d+)(\.\d{1,2})?"
DOLLARS = r"\$\s?(\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)"


def rounded(col: Column, places: int = 0) -> Column:
    """Half up on the binary value, in plain arithmetic, so every engine gives the same last digit."""
    scale = float(10 ** places)
    return F.floor(col * scale + 0.5) / scale


def bind(value: Column, read) -> Column:
    """`read(value)` with the value worked out once, however often `read` uses it: a lambda's variable is not copied into the
    expression as a column is, so long chains stay short and fit a generated method."""
    return F.get(F.transform(F.array(value), read), 0)


def plain(col: Column) -> bool:
    """Whether a column is a name, which may stand in an expression often: anything else is worked out wherever it stands."""
    return re.fullmatch(r"Column<'\w+(?:\.\w+|\['\w+'\])*'>", str(col)) is not None


def once(value: Column, read) -> Column:
    """`read(value)`, bound unless the value is a name."""
    return read(value) if plain(value) else bind(value, read)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null where the pattern or the group does not match."""
    return bind(F.regexp_extract(text, pattern, group), lambda x: F.nullif(x, F.lit("")))


def number(text: Column) -> Column:
    """Digits with optional separators as a double, null when there are none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def fn_money(col: Column) -> Column:
    """The first amount in a text; zero and less are no price."""
    return bind(rounded(number(found(col.cast("string"), AMOUNT, 0)), 2), lambda x: F.nullif(x, F.lit(0.0)))


def fn_pct(price: Column, ref: Column) -> Column:
    """Percent below the reference price, one place; null unless the price is lower."""
    return F.when((ref > 0) & (price < ref), rounded((1 - price / ref) * 100, 1))


def general(col: Column) -> Column:
    """A number as short as it can be written: 25, 12.5."""
    return F.when(col == F.floor(col), F.floor(col).cast("string")).otherwise(col.cast("string"))


def dollars(col: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(col, 2))


def dollars_short(col: Column) -> Column:
    return F.regexp_replace(dollars(col), r"\.00$", "")
