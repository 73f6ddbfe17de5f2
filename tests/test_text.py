import unicodedata

import pytest
from pyspark.sql import functions as F

from placeweave.functions import media, text, trigram


def check(spark, cases, fn, kind="string"):
    """Apply a column function to all inputs in one job."""
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], f"i int, c {kind}")
    got = {r["i"]: r["v"] for r in df.select("i", fn("c").alias("v")).collect()}
    assert {raw if not isinstance(raw, list) else tuple(raw): got[i] for i, (raw, _) in enumerate(cases)} == {
        raw if not isinstance(raw, list) else tuple(raw): want for raw, want in cases}


def ascii_of(ch):
    """What is left of a character: itself, or what its entries in the Unicode data lead to."""
    if ch.isascii():
        return ch
    parts = [p for p in unicodedata.decomposition(ch).split() if not p.startswith("<")]
    return "".join(ascii_of(chr(int(p, 16))) for p in parts)


def test_tokens_keep_the_ascii_part_of_every_character(spark):
    points = [p for p in range(0x21, 0x20000) if not 0xD800 <= p <= 0xDFFF and p != ord("&") and not chr(p).isspace()]
    df = spark.createDataFrame([(p, f"a{chr(p)}z") for p in points], "p int, c string")
    rows = df.select("p", F.lower("c").alias("low"), text.norm_token("c").alias("v")).collect()
    # Letter case is Spark's.
    assert [r["p"] for r in rows if r["v"] != "".join(map(ascii_of, r["low"]))] == []


def test_blanks_and_ampersands_in_tokens(spark):
    blanks = [chr(p) for p in (0x09, 0x0A, 0x0D, 0x1C, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x205F, 0x3000)]
    check(spark, [(f"{b}tea{b}{b} house{b}", "tea house") for b in blanks] + [
        ("tea&house", "tea and house"), ("tea & house", "tea and house"), ("&", " and "), ("&&", " and and "),
    ], text.norm_token)


def test_norm_token(spark):
    check(spark, [
    ("  Café & Bar ", "cafe and bar"), ("ﬁsh ㏎", "fish KM"), ("", ""), ("中文", ""), ("A&B", "a and b"), (None, None),
    ("Ω ① ½", " 1 12"),
], text.norm_token)


def test_slug(spark):
    check(spark, [("Tea & Co!", "tea-co"), ("--x--", "x"), ("Café 1", "caf-1")], text.slug)


def test_phone(spark):
    check(spark, [
    ("+65 6123-4567", "+6561234567"), ("07-123 4567", "+6071234567"), ("61234567", "+6561234567"), ("9123.4567", "+6591234567"),
    ("123456789", "+60123456789"), ("1234567890", "+601234567890"), ("60123456789", "+60123456789"), ("6512", "+6512"),
    ("61234567.0", "+6561234567"), ("21234567", "+21234567"), ("abc", None), ("", None), ("nan", None), (None, None), ("None", None),
    ("(03) 1/2", "+60312"), ("+65\u00a06123\u00a04567", "+6561234567"), ("9123\u30004567", "+6591234567"), ("07\u2009123\u202f4567", "+6071234567"),
], text.phone_e164)


def test_price(spark):
    check(spark, [
    ("$", 1), ("$$$$", 4), (" $$ ", 2), ("$20–50", 2), ("RM 1-19", 1), ("50", 2), ("51", 3), ("100", 3), ("100-101", 4), ("free", None), (None, None),
    ("$$$$$", None),
], text.price_level)


def test_category_tokens(spark):
    check(spark, [
    ('["A & B", " c ", ""]', ["a and b", "c"]), ("A, b,,C ", ["a", "b", "c"]), (None, []), ("['x']", ["['x']"]), ('{"a":1}', ['{"a":1}']),
    ("[1, true, null]", ["1", "true", "none"]), ("", []),
], text.category_tokens)


def test_loader_categories(spark):
    check(spark, [
    ("['Cafe', 'Bar']", ["cafe", "bar"]), ('["A"]', ["a"]), ("a|b,c", ["a", "b", "c"]), ("Solo", ["solo"]), (None, []), (" ", []),
], text.loader_categories)


def test_loader_json(spark):
    check(spark, [
    (None, None), ("{}", None), ('{"a":["b"]}', '{"a":["b"]}'), ("{'a': ['b'], 'c': None}", '{"a":["b"],"c":null}'), ("closed", "closed"),
], lambda c: text.loader_json(c, "map<string,array<string>>"))


def test_move_last(spark):
    check(spark, [
    (["tourist attraction", "a", "tourist attraction"], ["a", "tourist attraction"]), (["a"], ["a"]), ([], []), (None, None),
], lambda c: text.move_last(c, "tourist attraction"), "array<string>")


def test_base_name(spark):
    check(spark, [(" Cafe X @ Mall ", "cafe x"), (" Cafe ", " cafe "), (None, None)], text.base_name)


def test_country_tag(spark):
    check(spark, [
    ('{"country":"SG","state":"Johor"}'.replace(" ", ""), "SG"), ('{"state":"Johor","country":"MY"}', "Johor"), ('{"country":"MY"}', "MY"),
    ('{"country":"TH"}', None), (None, None),
], text.country_tag)


def test_image_urls(spark):
    check(spark, [
    ('[{"title":"All","image":"u1=w1"},{"title":"Street View","image":"u2"},{"title":"x","image":"a/StreetView"}]', ["u1"]),
    ('["u1=w2", "streetview/1"]', ["u1"]), (None, None), ("oops", None), ("[]", []), ('[{"title":"360 view","image":"u"}]', []),
], media.image_urls)


def test_preview(spark):
    check(spark, [(["a", "b"], ["a"]), ([], []), (None, [])], media.preview_image, "array<string>")


def test_similarity(spark):
    cases = [("word", "two words", 4 / 11), ("", "", 0.0), ("abc", "abc", 1.0), ("abc", "xyz", 0.0), ("ABC", "abc", 1.0)]
    df = spark.createDataFrame(cases, "a string, b string, want double")
    x, y = trigram.trigrams("a"), trigram.trigrams("b")
    for r in df.select("*", trigram.similarity(x, y).alias("s"), trigram.similarity(y, x).alias("t")).collect():
        assert r["s"] == pytest.approx(r["want"]) and r["s"] == r["t"]
