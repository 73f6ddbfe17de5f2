"""Text standardisation: tokens, slugs, phones, prices, categories, country tags."""

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave.constants import BRAND_EXEMPTIONS, BRAND_MIN_LENGTH

# White space as Python's str.strip and \s see it; Java's \s alone is ASCII.
_SPACES = "".join(map(chr, (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
_SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACE_RUN = f"[{_SPACE}]+"
_NON_ASCII = r"[^\x00-\x7F]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(_SPACES))


def squeeze(c) -> Column:
    return F.regexp_replace(_col(c), _SPACE_RUN, " ")


@lru_cache(maxsize=1)
def _folds():
    """Characters whose compatibility decomposition keeps ASCII, by length of what is kept."""
    one, many = {}, {}
    for point in range(0x80, 0x20000):
        ch = chr(point)
        if not unicodedata.decomposition(ch):
            continue
        kept = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")
        if len(kept) == 1:
            one[ch] = kept
        elif kept:
            many[ch] = kept
    return one, many


def to_ascii(c) -> Column:
    """Compatibility-decompose, then drop what is not ASCII. A decomposition works character
    by character, so a lookup table generated from the Unicode data gives the same text and
    stays out of Python workers. ASCII strings skip the tables, and strings without a character
    that becomes several skip the slower one."""
    one, many = _folds()
    table = F.from_json(F.lit(json.dumps(many)), "map<string,string>")

    def widen(s):
        present = F.array_distinct(F.regexp_extract_all(s, F.lit(f"({_NON_ASCII})"), F.lit(1)))
        known = F.filter(present, lambda ch: F.try_element_at(table, ch).isNotNull())
        return F.aggregate(known, s, lambda acc, ch: F.replace(acc, ch, F.try_element_at(table, ch)))

    def fold(s):
        widened = F.when(F.translate(s, "".join(many), "") == s, s).otherwise(widen(s))
        narrow = F.translate(widened, "".join(one), "".join(one.values()))
        return F.when(s.rlike(_NON_ASCII), F.regexp_replace(narrow, _NON_ASCII, "")).otherwise(s)

    return once(_col(c), fold)


def norm_token(c) -> Column:
    """One token form for categories, role lists and theme lists alike."""
    spaced = squeeze(F.replace(F.lower(strip(c)), F.lit("&"), F.lit(" and ")))
    return to_ascii(spaced)


def slug(c) -> Column:
    dashed = F.regexp_replace(squeeze(F.lower(strip(c))), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def unify_punctuation(c) -> Column:
    """Narrow no-break space to space, en dash to hyphen."""
    return F.translate(_col(c), chr(0x202F) + chr(0x2013), " -")


def phone_e164(c) -> Column:
    raw = strip(c)
    raw = F.regexp_replace(raw, r"\.0$", "")
    d = F.regexp_replace(raw, rf"[{_SPACE}\-().\/]", "")
    first, size = F.substring(d, 1, 1), F.length(d)
    number = (
        F.when(first == "+", d)
        .when(first == "0", F.concat(F.lit("+60"), F.substring(d, F.lit(2), size)))
        .when((size == 8) & first.isin("6", "8", "9"), F.concat(F.lit("+65"), d))
        .when(size.isin(9, 10) & (first == "1"), F.concat(F.lit("+60"), d))
        .when(F.substring(d, 1, 2).isin("60", "65") | d.rlike(r"^\p{Nd}+$"), F.concat(F.lit("+"), d))
    )
    return F.when(~F.lower(strip(c)).isin("", "nan", "none"), number)


def price_level(c) -> Column:
    """Dollar signs count; otherwise the mean of the numbers in the text picks a level."""
    c = strip(c)
    numbers = F.transform(
        F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("double")
    )
    total = F.aggregate(numbers, F.lit(0.0), lambda acc, n: acc + n)
    n = F.size(numbers)
    return (
        F.when(c.rlike(r"^\${1,4}$"), F.length(c))
        .when(n == 0, F.lit(None).cast("int"))
        .when(total < n * 20, 1)
        .when(total <= n * 50, 2)
        .when(total <= n * 100, 3)
        .when(total.isNotNull(), 4)
    )


def comma_list(c) -> Column:
    """Trimmed non-empty items of comma-separated text; null gives an empty list."""
    items = F.filter(F.transform(F.split(_col(c), ","), strip), lambda x: x != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def _json_list(c, python_quotes: bool) -> Column:
    c = _col(c)
    parsed = F.from_json(c, "array<string>", {"allowSingleQuotes": str(python_quotes).lower()})
    parsed = F.transform(parsed, lambda x: F.coalesce(x, F.lit("None")))
    return F.when(F.ltrim(c).startswith("["), parsed)


def category_tokens(c) -> Column:
    """Category text (a JSON list, or comma-separated) to an array of normal tokens."""
    items = F.coalesce(_json_list(strip(c), False), comma_list(c))
    return F.filter(F.transform(items, norm_token), lambda t: t != "")


def loader_categories(c) -> Column:
    """The loading step's reading: a JSON or Python list, else split on commas and bars."""
    split = F.split(F.translate(strip(c), "|", ","), ",")
    items = F.coalesce(_json_list(strip(c), True), split, F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda x: F.lower(strip(x))), lambda x: x != "")


def move_last(categories, token: str) -> Column:
    """Put one category at the end, once, when it is present."""
    c = _col(categories)
    return F.when(
        F.array_contains(c, token), F.concat(F.array_remove(c, token), F.array(F.lit(token)))
    ).otherwise(c)


def country_tag(address) -> Column:
    a = _col(address)
    return (
        F.when(a.contains('"country":"SG"'), "SG")
        .when(a.contains('"state":"Johor"'), "Johor")
        .when(a.contains('"country":"MY"'), "MY")
    )


def base_name(title) -> Column:
    """Brand part of a title: the text before the first @."""
    t = _col(title)
    return F.when(t.contains("@"), F.lower(strip(F.substring_index(t, "@", 1)))).otherwise(F.lower(t))


def is_flagship(title) -> Column:
    return F.coalesce(F.lower(_col(title)).contains("flagship"), F.lit(False))


def is_brand_exempt(base) -> Column:
    b = _col(base)
    return (F.length(b) <= BRAND_MIN_LENGTH) | b.isin(*BRAND_EXEMPTIONS)


def loader_json(c, shape: str) -> Column:
    """JSON text of a loader column that may hold a Python literal. `shape` is the column's
    type. Null and {} give null; text that fits neither stays as it is."""
    c = _col(c)
    options = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    repaired = c
    for python, json in (("None", "null"), ("True", "true"), ("False", "false")):
        repaired = F.regexp_replace(repaired, rf"(?<=[\[,:]\s?){python}(?=\s?[,\]\}}])", json)
    literal = F.to_json(F.from_json(repaired, shape, options), {"ignoreNullFields": "false"})
    as_is = F.when(F.try_parse_json(c).isNotNull(), c)
    return F.when(F.trim(c) != "{}", F.coalesce(as_is, literal, c))
