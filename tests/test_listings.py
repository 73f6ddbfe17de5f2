import json
import random

import pytest
from pyspark.sql import functions as F

from placeweave.functions import media
from placeweave.operators import classify, clean, dedup

LISTING = "link string, title string, complete_address string, review_count int, review_rating double"
SG, MY = '{"country":"SG"}', '{"country":"MY"}'


def links(df):
    return sorted(r["link"] for r in df.collect())


def test_dedup_titles_keeps_the_best_rated(spark):
    a = spark.createDataFrame([("1", "x", SG, 5, 4.0), ("2", "x", SG, 5, 4.5), ("3", None, SG, 1, 1.0)], LISTING)
    b = spark.createDataFrame([("4", "x", None), ("5", "y", None), ("0", None, None)], "link string, title string, extra string")
    out = dedup.dedup_titles(a, b)
    assert links(out) == ["2", "3", "5"] and "extra" in out.columns


BRANDS = [
    ("a1", "Coffee Empire @ East", SG, 500, 4.0), ("a2", "Coffee Empire @ West", SG, 500, 2.9), ("a3", "Coffee Empire", SG, 90, 4.9),
    ("a4", "Coffee Empire Flagship", SG, 1, 1.0), ("a5", "coffee empire @ North", SG, None, None), ("a6", "Coffee Empire @ X", MY, 3, 3.0),
    ("a7", "Coffee Empire @ Z", None, 3, 3.0), ("b1", "Ten letter @ 1", SG, 1, 1.0), ("b2", "Ten letter @ 2", SG, 1, 1.0),
    ("c1", "Restoran Al @ 1", SG, 1, 1.0), ("c2", "Restoran Al", SG, 1, 1.0),
    ("d1", "Swiss_House Bakery @ 1", SG, 2, 1.0), ("d2", "Swiss_House Bakery @ 2", SG, 1, 1.0), ("e1", None, SG, 1, 1.0), ("e2", None, SG, 1, 1.0),
    ("f1", "Eleven char @ 1", SG, 7, 3.0), ("f2", "Eleven char @ 2", SG, 7, 3.0),
    ("g1", "Universal Studios @ Flagship", SG, 1, 1.0), ("g2", "Universal Studios", SG, 1, 1.0),
    ("h1", "Noodle House Tan @ Flagship Mall", SG, 1, 1.0), ("h2", "Noodle House Tan", SG, 9, 1.0),
]


def test_brand_country(spark):
    df = spark.createDataFrame(BRANDS, LISTING)
    kept = links(dedup.dedup_brand_country(df))
    removed = {"a3", "a5", "d2", "f2"}
    assert kept == sorted({r[0] for r in BRANDS} - removed)
    log = {r["link"]: (r["action"], r["reason"]) for r in dedup.brand_country_log(df).collect()}
    assert log == {
        "a1": ("KEEP", "exceeds threshold"), "a2": ("KEEP", "best below-threshold"), "a3": ("REMOVE", "not best below-threshold"),
        "a5": ("REMOVE", "not best below-threshold"), "d1": ("KEEP", "best below-threshold"), "d2": ("REMOVE", "not best below-threshold"),
        "f1": ("KEEP", "best below-threshold"), "f2": ("REMOVE", "not best below-threshold"),
        "h1": ("KEEP", "flagship"), "h2": ("KEEP", "best below-threshold"),
    }
    total = dedup.removal_summary(df, dedup.dedup_brand_country(df)).first()
    assert (total["original"], total["kept"], total["removed"]) == (len(BRANDS), len(kept), len(removed))


def pruned(rows, patterns, flagship, exact, ranked):
    """What stays: a listing goes if some pattern that it matches does not protect it, by its own
    merits or by there being no better listing that matches in the country."""
    def matches(r, country, pattern):
        return r[1] is not None and r[2] is not None and f'"{country}"' in r[2] and pattern.lower() in r[1].lower()

    def merit(r):
        return (r[3] is not None, r[3] or 0, r[4] is not None, r[4] or 0)

    def better(a, b):
        return merit(a) > merit(b) or (merit(a) == merit(b) and a[0] < b[0])

    def goes(r, country, pattern):
        own = (flagship and "flagship" in r[1].lower()) or (exact and r[1].lower() == pattern.lower())
        best = ranked and not any(better(o, r) for o in rows if matches(o, country, pattern))
        return not own and not best

    return sorted({r[0] for r in rows if not any(
        matches(r, c, p) and goes(r, c, p) for c in ("SG", "MY") for p in patterns)})


def test_prune_keeps_what_no_pattern_takes(spark):
    rng = random.Random(3)
    words = ["Al", "tea", "TEA", "house", "Flagship", "kopi", "x"]
    rows = [(f"l{i:03}", " ".join(rng.choices(words, k=rng.randint(1, 3))) if i % 17 else None,
             rng.choice([SG, MY, None]), rng.choice([None, 1, 5, 9]), rng.choice([None, 1.0, 3.5])) for i in range(300)]
    patterns = ["tea", "Kopi x", "a", "ho", " house ", "", "house"]
    df = spark.createDataFrame(rows, LISTING)
    pats = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    clean_patterns = list(dict.fromkeys(p.strip() for p in patterns if p.strip()))
    for flagship, exact, ranked in ((True, True, True), (False, True, True), (True, False, False)):
        got = links(dedup.prune_by_patterns(df, pats, flagship, exact, ranked))
        assert got == pruned(rows, clean_patterns, flagship, exact, ranked)
    assert dedup.prune_by_patterns(df, pats, dry_run=True).count() == 300
    none = spark.createDataFrame([], "pattern string")
    assert dedup.prune_by_patterns(df, none).count() == 300


def test_prune_tells_rows_apart_without_links(spark):
    """Null and shared links and equal rows, against a plain version over row numbers."""
    rng = random.Random(8)
    titles = ["tea one", "tea two", "Tea", "house tea", "x", "flagship tea"]
    rows = [(rng.choice([None, "s", f"l{i}"]), rng.choice(titles), SG, rng.choice([None, 1, 9]), rng.choice([None, 2.0])) for i in range(60)]
    rows += rows[:25]
    df = spark.createDataFrame(rows, LISTING).repartition(4)
    for patterns in (["tea"], ["tea", "house", "two"], ["zzz", "tea"]):
        pats = spark.createDataFrame([(p,) for p in patterns], "pattern string")
        merit = [(r[3] is None, -(r[3] or 0), r[4] is None, -(r[4] or 0), r[0] is None, r[0] or "") for r in rows]
        matches, gone, ties = [], set(), False
        for p in patterns:
            found = sorted((merit[i], rows[i][1], i) for i in range(len(rows)) if p in rows[i][1].lower())
            matches += [rows[i][:2] for _, _, i in found]
            ties |= len({t for m, t, _ in found if m == found[0][0]}) > 1 if found else False
            gone |= {i for _, _, i in found[1:] if "flagship" not in rows[i][1].lower() and rows[i][1].lower() != p}
        got = sorted((tuple(r)[:2] for r in dedup.pattern_matches(df, pats).select("link", "title").collect()), key=repr)
        assert got == sorted(matches, key=repr)
        left = sorted(map(tuple, dedup.prune_by_patterns(df, pats).collect()), key=repr)
        want = sorted((rows[i] for i in range(len(rows)) if i not in gone), key=repr)
        assert len(left) == len(want) if ties else left == want


def test_a_pattern_meets_few_titles(spark):
    """A pattern that starts with a common piece is looked up by its rarest one."""
    titles = [(f"the tea house {i}",) for i in range(500)] + [("the teak quay",)]
    rows = spark.createDataFrame(titles, "title string").select(F.upper("title").alias("h"))
    held = rows.select(F.explode(dedup._pieces(F.col("h"), [3])).alias("piece"))
    needles = spark.createDataFrame([("the teak",), ("the tea",), ("the zoo",)], "pattern string").withColumn("needle", F.upper("pattern"))
    got = {r["pattern"]: r["piece"] for r in dedup.rarest_pieces(held, needles).collect()}
    assert got["the teak"] == "EAK" and set(got) == {"the teak", "the tea"}


def test_counts(spark):
    df = spark.createDataFrame(BRANDS, LISTING)
    counts = {r["country"]: r["listings"] for r in dedup.country_counts(df).collect()}
    assert counts == {"SG": 19, "MY": 1, None: 1}
    dup = {r["column_name"]: r["duplicate_rows"] for r in dedup.duplicate_counts(df, "title", "link").collect()}
    assert dup == {"title": 1, "link": 0}


def test_exclude_categories(spark):
    rows = [("keep all", ["tourist attraction", "bank"]), ("first", ["bank", "cafe"]), ("later", ["cafe", "bank", "cafe"]),
            ("empty", []), ("clean", ["cafe"]), ("null", None), ("both", ["bank", "tourist attraction"])]
    df = spark.createDataFrame(rows, "link string, categories array<string>")
    words = spark.createDataFrame([(" Bank ",), ("ATM",)], "token string")
    want = {"keep all": ["tourist attraction", "bank"], "later": ["cafe", "cafe"], "empty": [], "clean": ["cafe"], "null": None,
            "both": ["bank", "tourist attraction"]}
    assert {r["link"]: r["categories"] for r in clean.exclude_categories(df, words).collect()} == want
    assert clean.exclude_categories(df, None) is df


def test_exclude_categories_with_long_lists(spark, no_literals_no_broadcast):
    test_exclude_categories(spark)


def about(*sections):
    return json.dumps([{"name": n, "options": [{"name": o, "enabled": e} for o, e in options]} for n, options in sections])


def test_flags_and_sections(spark):
    rows = [("a", about(("Children", [("Good for kids", True)]), ("Pets", [("Dogs allowed", False)])), ["halal restaurant"], False),
            ("b", None, ["dog cafe"], True), ("c", "junk", None, None), ("d", '[{"name":"Pets"},{"options":[{"name":"Halal food","enabled":true}]}]', [], None)]
    df = spark.createDataFrame(rows, "link string, about string, categories array<string>, kids_friendly boolean")
    got = {r["link"]: r for r in clean.with_flags(df).collect()}
    assert [got[k]["kids_friendly"] for k in "abcd"] == [True, True, False, False]
    assert [got[k]["pets_friendly"] for k in "abcd"] == [False, True, False, False]
    assert [got[k]["halal_food"] for k in "abcd"] == [True, False, False, True]
    trimmed = {r["link"]: r["about"] for r in clean.trim_about(df).collect()}
    assert [s["name"] for s in json.loads(trimmed["a"])] == ["Children"] and trimmed["b"] is None and trimmed["c"] == "junk"
    pairs = {(r["section"], r["option_name"]) for r in clean.about_catalogue(df).collect()}
    assert pairs == {("Children", "Good for kids")}


def test_enrichment_overwrites_and_null_phones_do_not_match(spark):
    pois = spark.createDataFrame([("a", "+1", 2, "old", ["own"]), ("b", None, 3, "old", None), ("c", "+2", 1, "old", []), ("d", "+9", 1, "old", ["own"])],
                                 "link string, phone string, price_level int, descriptions string, images array<string>")
    guide = spark.createDataFrame([("z", "+1", "$$$$", "late", ["z"]), ("y", "+1", None, None, ["y1", "y2"]), ("x", None, "$", "none", ["x"]), ("w", "+2", "$$", "new", [])],
                                  "name string, phone string, price string, description string, images array<string>")
    got = {r["link"]: tuple(r)[2:] for r in clean.enrich_from_guide(pois, guide).collect()}
    assert got == {"a": (None, None, ["y1", "y2", "own"]), "b": (3, "old", []), "c": (2, "new", []), "d": (1, "old", ["own"])}


def test_guide_columns(spark):
    raw = spark.createDataFrame([(1, "A", "61234567", "$$", "i1, i2"), (2, "A", None, None, None)], "ID int, Name string, PhoneNumber string, PriceRange string, Images string")
    row = clean.clean_guide(raw).first()
    assert row.asDict() in ({"name": "A", "phone": "+6561234567", "price": "$$", "images": ["i1", "i2"]}, {"name": "A", "phone": None, "price": None, "images": []})
    assert clean.clean_guide(raw).count() == 1


def test_clean_listings(spark):
    raw = spark.createDataFrame([
        ("l1", "Café – A", "Tourist attraction, Bank", SG, 60, 3.0, "91234567", "$", None, None, "x"),
        ("l2", "Café – A", "cafe", SG, 99, 4.0, None, None, None, None, "x"),
        ("l3", "Low", "cafe", SG, 49, 4.0, None, None, None, None, "x"), ("l4", "Null", "cafe", SG, None, 4.0, None, None, None, None, "x"),
        ("l5", "Far", "cafe", '{"country":"TH"}', 90, 4.0, None, None, None, None, "x"), ("l6", "Bad", "cafe", MY, 90, 2.4, None, None, None, None, "x")],
        "link string, title string, categories string, complete_address string, review_count int, review_rating double, phone string, price_range string, images string, about string, cid string")
    rows = clean.clean_listings(raw, spark.createDataFrame([("bank",)], "token string")).collect()
    assert [(r["link"], r["name"], r["categories"], r["phone"], r["price_level"]) for r in rows] == [
        ("l1", "Café - A", ["bank", "tourist attraction"], "+6591234567", 1)]
    assert "cid" not in rows[0].asDict()


def test_buckets_and_theme_lists(spark):
    labels = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "e repair", " a ", "")], "label string")
    log = spark.createDataFrame([(1, "a", ["exclude"]), (2, "a", ["meal", "exclude"]), (3, "b", ["exclude"]), (4, "c", ["unique", "attractions/shopping"]),
                                 (5, "z", ["accommodation"]), (6, "e repair", ["attractions/nature", "meal"]), (7, "d", [])], "seq int, label string, buckets array<string>")
    rows = classify.resolve_buckets(labels, log)
    assert {tuple(r) for r in rows.collect()} == {
        ("meal", "a"), ("exclude", "b"), ("unique", "c"), ("attractions/shopping", "c"), ("accommodation", "z"),
        ("attractions/nature", "e repair"), ("meal", "e repair"), ("unique", "d")}
    def words(*w):
        return spark.createDataFrame([(x,) for x in w], "label string")
    lists = classify.build_theme_lists(rows, words("e repair"), words("z"))
    assert {tuple(r) for r in lists.collect()} == {("food_tour", "a", "a"), ("food_tour", "e repair", "e-repair"), ("nature", "e repair", "e-repair")}
    # A theme without buckets has the default ones.
    every = classify.build_theme_lists(rows, words(), words(), policy={"all": ((), ()), "stay": (("accommodation",), ())})
    assert {(r["theme"], r["label"]) for r in every.collect()} == {("all", "a"), ("all", "z"), ("stay", "z")}
    plain = classify.build_theme_lists(rows, words("c"), words())
    assert {(r["theme"], r["label"]) for r in plain.collect()} == {("food_tour", "a"), ("shopping", "c"), ("stay", "z")}


def test_batches_are_full_and_whole(spark):
    lines = spark.createDataFrame([(f" line {i % 97} ",) for i in range(500)] + [("",), ("  ",)], "line string")
    for digits in (1, 3, 4):
        rows = classify.distinct_batches(lines, 10, digits).collect()
        sizes = {}
        for r in rows:
            sizes[r["batch_no"]] = sizes.get(r["batch_no"], 0) + 1
        assert len({r["line"] for r in rows}) == len(rows) == 97
        assert [sizes[k] for k in sorted(sizes)] == [10] * 9 + [7]
    with pytest.raises(ValueError):
        classify.distinct_batches(lines, 10, 9)


def test_replies(spark):
    rows = [(1, '```json\n{"results":[{"label":"a","buckets":["meal","x"]}]}\n```', ["a", "b"]), (2, "sorry", ["c"]),
            (3, 'ok {"results":[{"label":"d","buckets":["exclude"]},{"label":"d","buckets":["meal"]}]} bye', ["d"])]
    df = spark.createDataFrame(rows, "seq int, reply string, labels array<string>")
    got = {(r["seq"], r["label"]): r["buckets"] for r in classify.read_replies(df).collect()}
    assert got == {(1, "a"): ["meal"], (1, "b"): [], (3, "d"): ["meal"]}


def test_merge_images(spark):
    df = spark.createDataFrame([(["g"], ["o"]), (None, ["o"]), (["g"], None), (None, None)], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(media.merge_images("a", "b")).collect()] == [["g", "o"], ["o"], ["g"], []]
