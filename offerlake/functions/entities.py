"""Character references of HTML and escapes of script strings, as column expressions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import bind

# A reference: decimal, hexadecimal, or a name with or without its semicolon.
REFERENCE = r"&(#[0-9]{1,8};?|#[xX][0-9a-fA-F]{1,8};?|[A-Za-z][A-Za-z0-9]{1,31};?)"
# Names that count without a semicolon, also at the start of a longer word; the longest first.
BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))


def code_point(n: Column) -> Column:
    """The character of a number; what is none is the replacement character. Numbers 128 to 159 are read as the Windows code page."""
    low = {i: bytes([i]).decode("cp1252", "replace") for i in range(0x80, 0xA0)}
    page = F.array(*[F.lit(low[i]) for i in range(0x80, 0xA0)])
    bad = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return F.when(bad, "\ufffd").when(n.between(0x80, 0x9F), F.get(page, (n - 0x80).cast("int"))).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


# All names as one text, which becomes a map once a job; a list of literals would be analysed entry by entry.
NAMES = "\x01".join(f"{name}\x02{char}" for name, char in html5.items())


def decoded(reference: Column) -> Column:
    """What one reference, without its "&", stands for; itself if it is none."""
    names = F.str_to_map(F.lit(NAMES), F.lit("\x01"), F.lit("\x02"))
    digits = F.regexp_extract(reference, r"^#[xX]?([0-9a-fA-F]+)", 1)
    number = F.when(reference.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    part = lambda g: F.regexp_extract(reference, f"^({BARE})(.*)$", g)
    tries = F.array(F.struct(reference.alias("k"), F.lit("").alias("rest")), F.struct(part(1).alias("k"), part(2).alias("rest")))
    named = F.get(F.array_compact(F.transform(tries, lambda x: F.concat(F.try_element_at(names, x["k"]), x["rest"]))), 0)
    return F.when(reference.startswith("#"), bind(number, code_point)).otherwise(F.coalesce(named, F.concat(F.lit("&"), reference)))


def fn_unescape(text: Column) -> Column:
    """A text with its character references decoded once. Texts without "&" are passed on as they are."""
    pieces = F.split(text, REFERENCE)
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    joined = bind(found, lambda f: F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(decoded(F.get(f, i)), F.lit("")))), ""))
    return F.when(text.contains("&"), joined).otherwise(text)


def fn_unescape_string(text: Column) -> Column:
    """The body of a JSON or script string as the text it stands for; one that is no JSON string is left as it is, without its backslashes."""
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "$.v"), F.regexp_replace(text, r"\\\\(.)", "$1"))
