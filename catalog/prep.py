"""Queries on listing preparation: duplicates, cleaning, enrichment, labels and word lists."""

from pyspark.sql import functions as F

from catalog.base import load
from catalog.registry import query
from catalog.places import areas, edges, role_map
from placeweave import constants as K
from placeweave.functions import media, text
from placeweave.operators import classify, clean, dedup, poi
from placeweave.plans.prepare import prepare_places as prepare

EXEMPT = "'restoran al', 'swiss', 'universal studios', 'jade', 'yishun town', 'pasar malam taman', 'pasar malam jalan'"

# Listings with what the brand rule looks at, for the oracles.
def branded(source: str) -> str:
    return f"""
SELECT *, CASE WHEN contains(title, '@') THEN lower(trim(split_part(title, '@', 1))) ELSE lower(title) END AS base_name,
       CASE WHEN complete_address LIKE '%"country":"SG"%' THEN 'SG' WHEN complete_address LIKE '%"state":"Johor"%' THEN 'Johor'
            WHEN complete_address LIKE '%"country":"MY"%' THEN 'MY' END AS country,
       title ILIKE '%flagship%' AS is_flagship,
       coalesce(review_count > 100 AND review_rating >= 3.0, false) AS exceeds_threshold
FROM {source}
"""


def grouped(source: str) -> str:
    return f"""
SELECT *, count(*) OVER (PARTITION BY base_name, country) AS n,
       row_number() OVER (PARTITION BY base_name, country, NOT exceeds_threshold AND NOT is_flagship
                          ORDER BY review_count DESC NULLS LAST, review_rating DESC NULLS LAST, link) AS rn,
       length(base_name) <= 10 OR base_name IN ({EXEMPT}) AS exempt
FROM ({branded(source)})
"""


_BRANDED, _GROUPED = branded("listings"), grouped("listings")
_KEPT = "(country IS NULL OR n = 1 OR exempt OR exceeds_threshold OR is_flagship OR rn = 1)"


def listings(spark, sf):
    return load(spark, sf, "SELECT link, title, complete_address, review_count, review_rating FROM listings")


@query("""SELECT link, title, review_rating FROM (
            SELECT *, row_number() OVER (PARTITION BY title ORDER BY review_rating DESC NULLS LAST, link) AS rn FROM listings)
          WHERE rn = 1""")
def dedup_titles(spark, sf):
    df = listings(spark, sf)
    even = df.filter("CAST(right(link, 1) AS INT) % 2 = 0")
    odd = df.filter("CAST(right(link, 1) AS INT) % 2 = 1").drop("review_count")
    return dedup.dedup_titles(even, odd).select("link", "title", "review_rating")


@query(f"""SELECT link, title FROM ({_GROUPED})
           WHERE {_KEPT}""")
def dedup_brand_country(spark, sf):
    return dedup.dedup_brand_country(listings(spark, sf)).select("link", "title")


@query(f"""SELECT link, base_name, country, CASE WHEN exceeds_threshold OR is_flagship OR rn = 1 THEN 'KEEP' ELSE 'REMOVE' END AS action,
             CASE WHEN exceeds_threshold THEN 'exceeds threshold' WHEN is_flagship THEN 'flagship'
                  WHEN rn = 1 THEN 'best below-threshold' ELSE 'not best below-threshold' END AS reason
           FROM ({_GROUPED}) WHERE country IS NOT NULL AND n > 1 AND NOT exempt""")
def brand_country_log(spark, sf):
    return dedup.brand_country_log(listings(spark, sf)).select("link", "base_name", "country", "action", "reason")


@query(f"SELECT link, base_name, country, is_flagship, exceeds_threshold FROM ({_BRANDED})")
def brand_marks(spark, sf):
    return listings(spark, sf).select(
        "link", text.base_name("title").alias("base_name"), text.country_tag("complete_address").alias("country"),
        text.is_flagship("title").alias("is_flagship"),
        F.coalesce((F.col("review_count") > 100) & (F.col("review_rating") >= 3.0), F.lit(False)).alias("exceeds_threshold"))


def hits(source: str) -> str:
    return f"""
SELECT b.link, b.title, b.country, p.pattern, b.is_flagship, lower(b.title) = lower(p.pattern) AS is_exact,
       row_number() OVER (PARTITION BY b.country, p.pattern
                          ORDER BY b.review_count DESC NULLS LAST, b.review_rating DESC NULLS LAST, b.link) AS rn
FROM ({branded(source)}) b JOIN patterns p ON contains(upper(b.title), upper(p.pattern)) AND b.country IS NOT NULL
"""


_HITS = hits("listings")


@query(f"SELECT link, title FROM listings WHERE link NOT IN (SELECT link FROM ({_HITS}) WHERE NOT is_flagship AND NOT is_exact AND rn > 1)")
def prune_by_patterns(spark, sf):
    patterns = load(spark, sf, "SELECT pattern FROM patterns")
    return dedup.prune_by_patterns(listings(spark, sf), patterns).select("link", "title")


def _scraped(spark, sf):
    return load(spark, sf, "SELECT link, title, complete_address, review_count, review_rating FROM scraped")


_ALL = "link, title, complete_address, review_count, review_rating"
# Equal rows are told apart by a number; all but the first of them come after it in the ranking.
_NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY {_ALL}) AS copy, row_number() OVER () AS row FROM scraped"
_SCRAPED_HITS = hits(f"({_NUMBERED})").replace("b.link)", "b.link NULLS LAST, b.title, b.copy)").replace("SELECT b.link,", "SELECT b.row, b.link,")


@query(f"""WITH numbered AS MATERIALIZED ({_NUMBERED}), hit AS ({_SCRAPED_HITS.replace(f"({_NUMBERED})", "numbered")})
           SELECT link, title, review_count FROM numbered WHERE row NOT IN (SELECT row FROM hit WHERE NOT is_flagship AND NOT is_exact AND rn > 1)""")
def prune_scraped(spark, sf):
    """Pruning of rows without links, with shared links and with copies."""
    patterns = load(spark, sf, "SELECT pattern FROM patterns")
    return dedup.prune_by_patterns(_scraped(spark, sf), patterns).select("link", "title", "review_count")


@query(f"SELECT link, title, pattern, is_exact FROM ({hits('scraped')})")
def scraped_matches(spark, sf):
    patterns = load(spark, sf, "SELECT pattern FROM patterns")
    return dedup.pattern_matches(_scraped(spark, sf), patterns).select("link", "title", "pattern", "is_exact")


@query(f"SELECT link, country, pattern FROM ({_HITS}) WHERE NOT is_exact")
def pattern_removals_unranked(spark, sf):
    patterns = load(spark, sf, "SELECT pattern FROM patterns")
    return dedup.pattern_removals(listings(spark, sf), patterns, keep_flagship=False, rank_by_reviews=False)


@query(f"""SELECT count(*) AS original, count(*) FILTER (WHERE {_KEPT}) AS kept,
             count(*) FILTER (WHERE NOT {_KEPT}) AS removed
           FROM ({_GROUPED})""")
def removal_summary(spark, sf):
    df = listings(spark, sf)
    return dedup.removal_summary(df, dedup.dedup_brand_country(df))


@query(f"SELECT coalesce(country, 'none') AS country, count(*) AS listings FROM ({_BRANDED}) GROUP BY country")
def country_counts(spark, sf):
    return dedup.country_counts(listings(spark, sf)).withColumn("country", F.coalesce("country", F.lit("none")))


def _dup_sql(c: str) -> str:
    return (f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct_values, "
            f"count(*) - count(DISTINCT {c}) - max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS duplicate_rows FROM listings")


@query(" UNION ALL ".join(_dup_sql(c) for c in ("title", "complete_address", "review_count")))
def duplicate_counts(spark, sf):
    return dedup.duplicate_counts(listings(spark, sf), "title", "complete_address", "review_count")


_FOLD = "regexp_replace(strip_accents(regexp_replace(replace(lower(regexp_replace({t}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')), '&', ' and '), '[\\s\\x{{a0}}]+', ' ', 'g')), '[^\\x00-\\x7F]', '', 'g')"


@query(f"SELECT doc_id, md5(n) AS token_md5, length(n) AS token_length FROM (SELECT doc_id, {_FOLD.format(t='text')} AS n FROM documents)")
def norm_token(spark, sf):
    df = load(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", text.norm_token("text").alias("n"))
    return df.select("doc_id", F.md5("n").alias("token_md5"), F.length("n").cast("bigint").alias("token_length"))


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[^a-z0-9]+', '-', 'g'), '-')) AS slug_md5 FROM documents""")
def slugs(spark, sf):
    df = load(spark, sf, "SELECT doc_id, text FROM documents")
    return df.select("doc_id", F.md5(text.slug("text")).alias("slug_md5"))


@query("SELECT doc_id, md5(replace(replace(text, chr(8239), ' '), chr(8211), '-')) AS text_md5 FROM documents")
def unify_punctuation(spark, sf):
    df = clean.unify_strings(load(spark, sf, "SELECT doc_id, text FROM documents"))
    return df.select("doc_id", F.md5("text").alias("text_md5"))


_E164 = """
SELECT c_custkey, c_name, c_mktsegment, CASE WHEN d = '' OR d IN ('nan', 'none') THEN NULL
    WHEN regexp_matches(d, '^[+]') THEN d
    WHEN regexp_matches(d, '^0') THEN '+60' || d[2:]
    WHEN regexp_matches(d, '^[689].{7}$') THEN '+65' || d
    WHEN regexp_matches(d, '^1.{8,9}$') THEN '+60' || d
    WHEN regexp_matches(d, '^6[05]') OR regexp_matches(d, '^[0-9]+$') THEN '+' || d END AS phone
FROM (SELECT *, regexp_replace(regexp_replace(trim(phone), '[.]0$', ''), '[- ().\\s/\\x{a0}\\x{3000}]', '', 'g') AS d FROM phones)
"""


@query(f"SELECT c_custkey, phone FROM ({_E164})")
def phone_e164(spark, sf):
    return load(spark, sf, "SELECT c_custkey, phone FROM phones").withColumn("phone", text.phone_e164("phone"))


PRICES = """
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '$' WHEN 1 THEN '$$' WHEN 2 THEN '$$$$' WHEN 3 THEN '$20-50' WHEN 4 THEN 'RM ' || CAST(p_size AS STRING)
  WHEN 5 THEN 'RM ' || CAST(p_size * 2 AS STRING) || '-' || CAST(p_size * 6 AS STRING) WHEN 6 THEN NULL ELSE 'ask' END AS price, p_size FROM part
"""


@query(f"""SELECT p_partkey, CAST(CASE p_partkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 2
             WHEN 4 THEN CASE WHEN p_size < 20 THEN 1 WHEN p_size <= 50 THEN 2 ELSE 3 END
             WHEN 5 THEN CASE WHEN p_size * 4 < 20 THEN 1 WHEN p_size * 4 <= 50 THEN 2 WHEN p_size * 4 <= 100 THEN 3 ELSE 4 END END AS INT) AS price_level
           FROM part""")
def price_level(spark, sf):
    return load(spark, sf, PRICES).select("p_partkey", text.price_level("price").alias("price_level"))


CATEGORY_TEXT = """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '[ "' || p_type || '", " ' || p_name || ' & Grill ", "", "Rest House"]'
  WHEN 1 THEN ' ' || p_type || ' , ' || p_name || ' & Grill,,Rest  House ' WHEN 2 THEN NULL ELSE p_name END AS categories FROM part
"""


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN '' WHEN 3 THEN p_name
            ELSE lower(p_type) || '|' || p_name || ' and grill|rest house' END AS categories FROM part""")
def split_categories(spark, sf):
    df = load(spark, sf, CATEGORY_TEXT)
    return df.select("p_partkey", F.array_join(text.category_tokens("categories"), "|").alias("categories"))


LOADER_TEXT = """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '["' || p_type || '", "' || p_name || '"]' WHEN 1 THEN '[''' || p_type || ''', ''' || p_name || ''']'
  WHEN 2 THEN p_type || ' | ' || p_name ELSE p_type || ',' || p_name || '|' END AS categories,
  CASE p_partkey % 5 WHEN 0 THEN '{}' WHEN 1 THEN NULL WHEN 2 THEN '{''Monday'': [''' || p_type || '''], ''Sunday'': None}'
    WHEN 3 THEN '{"Monday":["' || p_type || '"]}' ELSE 'open ' || p_type END AS open_hours FROM part
"""


@query("""SELECT p_partkey, lower(p_type) || '|' || p_name AS categories,
            CASE p_partkey % 5 WHEN 2 THEN '{"Monday":["' || p_type || '"],"Sunday":null}' WHEN 3 THEN '{"Monday":["' || p_type || '"]}'
              WHEN 4 THEN 'open ' || p_type END AS open_hours FROM part""")
def loader_parsing(spark, sf):
    df = load(spark, sf, LOADER_TEXT)
    return df.select("p_partkey", F.array_join(text.loader_categories("categories"), "|").alias("categories"),
                     text.loader_json("open_hours", "map<string,array<string>>").alias("open_hours"))


CATEGORIES = """
SELECT p_partkey, CASE WHEN p_partkey % 37 = 0 THEN '' ELSE
    CASE WHEN p_partkey % 11 = 0 THEN 'tourist attraction,' ELSE '' END || lower(p_type) || ',' || replace(p_name, ' ', ',') || CASE WHEN p_partkey % 29 = 0 THEN ',red' ELSE '' END END AS csv
FROM part
"""


def _categories(spark, sf):
    df = load(spark, sf, CATEGORIES)
    return df.select("p_partkey", text.comma_list("csv").alias("categories"))


@query(f"""SELECT p_partkey, CASE WHEN csv LIKE 'tourist attraction,%' THEN replace(csv, 'tourist attraction,', '') || ',tourist attraction' ELSE csv END AS categories
           FROM ({CATEGORIES})""")
def deprioritise_category(spark, sf):
    moved = _categories(spark, sf).withColumn("categories", text.move_last("categories", "tourist attraction"))
    return moved.select("p_partkey", F.array_join("categories", ",").alias("categories"))


@query(f"""SELECT p_partkey, array_to_string(CASE WHEN list_contains(c, 'tourist attraction') OR csv = '' THEN c ELSE kept END, ',') AS categories
           FROM (SELECT *, list_filter(c, lambda x: x NOT IN ('economy', 'red', 'ring')) AS kept
                 FROM (SELECT *, CASE WHEN csv = '' THEN [] ELSE string_split(csv, ',') END AS c FROM ({CATEGORIES})))
           WHERE csv = '' OR list_contains(c, 'tourist attraction') OR (c[1] NOT IN ('economy', 'red', 'ring') AND len(kept) > 0)""")
def exclude_categories(spark, sf):
    excluded = load(spark, sf, """SELECT DISTINCT ' ' || p_type AS token FROM part WHERE p_type = 'ECONOMY'
        UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part WHERE p_name LIKE '%ring' UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part WHERE p_name LIKE 'red%'""")
    kept = clean.exclude_categories(_categories(spark, sf), excluded, id_col="p_partkey")
    return kept.select("p_partkey", F.array_join("categories", ",").alias("categories"))


FLAG_CATS = """
SELECT p_partkey, p_name || CASE p_partkey % 6 WHEN 0 THEN ',halal restaurant' WHEN 1 THEN ',vegetarian cafe and deli' WHEN 2 THEN ',cat cafe,vegan restaurant'
  WHEN 3 THEN ',dog cafe' WHEN 4 THEN ',halal restaurants' ELSE '' END AS csv FROM part
"""


@query("""SELECT p_partkey, p_partkey % 6 = 0 AS halal_food, p_partkey % 6 = 1 AS vegetarian_options, p_partkey % 6 = 2 AS vegan_options,
            p_partkey % 6 IN (2, 3) AS pets_friendly FROM part""")
def flags_from_categories(spark, sf):
    df = load(spark, sf, FLAG_CATS).withColumn("categories", text.comma_list("csv"))
    return df.select("p_partkey", *[media.category_flag("categories", t).alias(n) for n, t in K.FLAG_CATEGORIES.items()])


ABOUT = """
SELECT p_partkey AS link, 'x' AS categories, CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 37 = 0 THEN 'not json' ELSE
 '[{"id":"access","name":"Accessibility","options":[{"name":"Wheelchair-accessible entrance","enabled":' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END
 || '},{"name":"Wheelchair-accessible toilet","enabled":' || CASE WHEN p_size % 3 = 0 THEN 'true' ELSE 'false' END
 || '}]},{"id":"pets","name":"Pets","options":[{"name":"DOGS allowed outside","enabled":' || CASE WHEN p_size % 5 = 0 THEN 'true' ELSE 'false' END
 || '}]},{"id":"kids","name":"Children","options":[{"name":"Good for kids birthday","enabled":' || CASE WHEN p_size % 7 = 0 THEN 'true' ELSE 'false' END
 || '},{"name":" ' || p_type || ' menu","enabled":true}]},{"id":"empty","name":"Payments"}]' END AS about, p_size, p_type, p_partkey % 10 = 0 AS kids_friendly
FROM part
"""
_ABOUT_OK = "p_partkey % 31 <> 0 AND p_partkey % 37 <> 0"


@query(f"""SELECT p_partkey AS link, ({_ABOUT_OK} AND p_size % 7 = 0) OR p_partkey % 10 = 0 AS kids_friendly, {_ABOUT_OK} AND p_size % 5 = 0 AS pets_friendly,
             {_ABOUT_OK} AND p_size % 2 = 0 AS wheelchair_accessible_entrance, {_ABOUT_OK} AND p_size % 3 = 0 AS wheelchair_accessible_toilet,
             false AS wheelchair_rental, false AS vegan_options FROM part""")
def about_flags(spark, sf):
    df = load(spark, sf, ABOUT).withColumn("categories", F.array("categories"))
    return clean.with_flags(df).select("link", "kids_friendly", "pets_friendly", "wheelchair_accessible_entrance",
                                       "wheelchair_accessible_toilet", "wheelchair_rental", "vegan_options")


@query("""SELECT p_partkey AS link, CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 37 = 0 THEN 'not json' ELSE 'Accessibility,Children' END AS sections FROM part""")
def trim_about(spark, sf):
    trimmed = clean.trim_about(load(spark, sf, ABOUT).select("link", "about"))
    names = F.array_join(F.transform(media.about_sections("about"), lambda s: s["name"]), ",")
    return trimmed.select("link", F.coalesce(names, "about").alias("sections"))


@query(f"""SELECT 'Accessibility' AS section, 'Wheelchair-accessible entrance' AS option_name FROM part WHERE {_ABOUT_OK} AND p_size % 2 = 0
           UNION SELECT 'Accessibility', 'Wheelchair-accessible toilet' FROM part WHERE {_ABOUT_OK} AND p_size % 3 = 0
           UNION SELECT 'Pets', 'DOGS allowed outside' FROM part WHERE {_ABOUT_OK} AND p_size % 5 = 0
           UNION SELECT 'Children', 'Good for kids birthday' FROM part WHERE {_ABOUT_OK} AND p_size % 7 = 0
           UNION SELECT 'Children', p_type || ' menu' FROM part WHERE {_ABOUT_OK}""")
def about_catalogue(spark, sf):
    return clean.about_catalogue(load(spark, sf, ABOUT))


IMAGES = """
SELECT p_partkey, CASE p_partkey % 6
  WHEN 0 THEN '[{"title":"All","image":"https://img.example/' || CAST(p_partkey AS STRING) || '=w200-h100"},{"title":"Street View & 360","image":"https://img.example/s"}]'
  WHEN 1 THEN '[{"title":"Latest","image":"https://x.example/StreetView/1"},{"image":"https://img.example/' || p_type || '=w1=w2"},{"title":"Menu"}]'
  WHEN 2 THEN '["https://img.example/' || p_type || '=w3","https://streetview.example/1"]' WHEN 3 THEN NULL WHEN 4 THEN 'broken' ELSE '[]' END AS images FROM part
"""


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'https://img.example/' || p_partkey WHEN 1 THEN 'https://img.example/' || p_type
            WHEN 2 THEN 'https://img.example/' || p_type WHEN 5 THEN '' END AS images FROM part""")
def clean_images(spark, sf):
    return load(spark, sf, IMAGES).select("p_partkey", F.array_join(media.image_urls("images"), ",").alias("images"))


def _guide(spark, sf):
    raw = load(spark, sf, "SELECT name, phone, price, description, images, seq FROM guide")
    return raw.withColumn("images", text.comma_list("images"))


@query(f"""SELECT p.c_custkey AS link, CAST(CASE WHEN g.name IS NULL THEN p.c_custkey % 4 + 1 WHEN g.price = '$$$' THEN 3 WHEN g.price IS NOT NULL THEN 4 END AS INT) AS price_level,
             CASE WHEN g.name IS NULL THEN p.c_mktsegment ELSE g.description END AS descriptions,
             CASE WHEN g.images IS NULL THEN '' ELSE replace(g.images, ' , ', ',') || ',' END || 'own' AS images
           FROM ({_E164}) p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY seq, name) AS rn FROM guide WHERE phone IS NOT NULL) g
             ON g.phone = p.phone AND g.rn = 1""")
def enrich_by_phone(spark, sf):
    df = load(spark, sf, "SELECT c_custkey AS link, phone, CAST(c_custkey % 4 + 1 AS INT) AS price_level, c_mktsegment AS descriptions FROM phones")
    df = df.withColumn("phone", text.phone_e164("phone")).withColumn("images", F.array(F.lit("own")))
    done = clean.enrich_from_guide(df, _guide(spark, sf))
    return done.select("link", "price_level", "descriptions", F.array_join("images", ",").alias("images"))


@query("""SELECT name, phone, price, images FROM (
            SELECT name, phone, price, coalesce(replace(images, ' , ', '|'), '') AS images,
                   row_number() OVER (PARTITION BY name ORDER BY seq) AS rn
            FROM (SELECT * FROM guide UNION ALL SELECT * REPLACE ('$' AS price, seq * 2 + 50 AS seq) FROM guide)) WHERE rn = 1""")
def clean_guide(spark, sf):
    """Each entry twice; which of the two is first in the file differs from name to name."""
    raw = load(spark, sf, 'SELECT name AS `Name`, phone AS `PhoneNumber`, price AS `PriceRange`, description AS `Description`, images AS `Images`, 1 AS `ID`, seq FROM guide')
    again = raw.withColumns({"PriceRange": F.lit("$"), "seq": F.col("seq") * 2 + 50})
    done = clean.clean_guide(raw.unionByName(again))
    return done.select("name", "phone", "price", F.array_join("images", "|").alias("images"))


@query(f"SELECT DISTINCT category FROM (SELECT unnest(string_split(csv, ',')) AS category FROM ({CATEGORIES})) WHERE category <> '' AND NOT contains(category, 'ol')")
def category_catalogue(spark, sf):
    return clean.category_catalogue(_categories(spark, sf), exclude_keywords=["OL"])


GROUPS = """
SELECT DISTINCT CASE split_part(p_name, ' ', 2) WHEN 'plate' THEN 'meal' WHEN 'ring' THEN 'accommodation' ELSE 'attractions/nature' END AS bucket,
       split_part(p_name, ' ', 2) AS token FROM part WHERE p_name NOT LIKE '%rod'
UNION SELECT DISTINCT 'exclude', p_brand FROM part UNION SELECT DISTINCT 'exclude', lower(p_type) FROM part WHERE p_type LIKE 'E%'
"""


@query(f"""SELECT category FROM (SELECT DISTINCT unnest(string_split(csv, ',')) AS category FROM ({CATEGORIES}))
           WHERE category <> '' AND category NOT IN (SELECT token FROM ({GROUPS}))""")
def uncategorised(spark, sf):
    known = clean.category_catalogue(_categories(spark, sf))
    return classify.manage_groups(known, load(spark, sf, GROUPS))[1]


@query(f"""SELECT bucket, token AS category FROM ({GROUPS}) WHERE token IN (SELECT unnest(string_split(csv, ',')) FROM ({CATEGORIES}))""")
def constrain_groups(spark, sf):
    known = clean.category_catalogue(_categories(spark, sf))
    return classify.manage_groups(known, load(spark, sf, GROUPS))[0]


TOKENS = """
SELECT CASE c_custkey % 6 WHEN 0 THEN 'meal' WHEN 1 THEN 'accommodation' WHEN 2 THEN 'accomodation' WHEN 3 THEN 'attractions/nature'
         WHEN 4 THEN 'unique' ELSE 'attractions/unknown' END AS bucket, ' ' || c_mktsegment || ' & Co ' || CAST(c_custkey % 700 AS STRING) AS token
FROM customer UNION ALL SELECT 'exclude', s_name FROM supplier
"""


@query(f"""SELECT DISTINCT replace(lower(trim(token)), ' & ', ' and ') AS category, CASE WHEN bucket = 'meal' THEN 'meal'
             WHEN bucket LIKE 'acc%' THEN 'accommodation' ELSE 'attraction' END AS role FROM ({TOKENS}) WHERE bucket <> 'exclude'""")
def build_role_map(spark, sf):
    return classify.build_role_map(load(spark, sf, TOKENS))


@query(f"SELECT DISTINCT 'nature' AS theme, replace(lower(trim(token)), ' & ', ' and ') AS category FROM ({TOKENS}) WHERE bucket = 'attractions/nature'")
def build_theme_map(spark, sf):
    return classify.build_theme_map(load(spark, sf, TOKENS))


def _labels(spark, sf):
    return load(spark, sf, "SELECT label FROM cat_labels")


def _assignments(spark, sf):
    df = load(spark, sf, "SELECT seq, label, buckets_csv FROM assignments")
    return df.withColumn("buckets", text.comma_list("buckets_csv")).drop("buckets_csv")


_LAST = """
SELECT l.label, a.label IS NOT NULL AS known, coalesce(list_filter(string_split(a.buckets_csv, ','), lambda b: b <> ''), []) AS b
FROM cat_labels l LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq DESC) AS rn FROM assignments) WHERE rn = 1) a ON a.label = l.label
"""
_BUCKETS = f"""
SELECT unnest(list_filter(b, lambda x: x NOT IN ('unique', 'exclude'))) AS bucket, label FROM ({_LAST})
UNION ALL SELECT 'exclude', label FROM ({_LAST}) WHERE list_contains(b, 'exclude') AND len(list_filter(b, lambda x: x NOT IN ('unique', 'exclude'))) = 0
UNION ALL SELECT 'unique', label FROM ({_LAST}) WHERE list_contains(b, 'unique') OR len(b) = 0
"""


@query(_BUCKETS)
def resolve_buckets(spark, sf):
    return classify.resolve_buckets(_labels(spark, sf), _assignments(spark, sf))


@query(f"SELECT label, array_to_string(list_sort(list(bucket)), ',') AS buckets FROM ({_BUCKETS}) WHERE bucket NOT IN ('unique', 'exclude') GROUP BY label")
def label_inverted_index(spark, sf):
    rows = classify.resolve_buckets(_labels(spark, sf), _assignments(spark, sf))
    return classify.label_index(rows).select("label", F.array_join("buckets", ",").alias("buckets"))


@query("SELECT label FROM cat_labels WHERE label NOT IN (SELECT label FROM assignments)")
def remaining_labels(spark, sf):
    return classify.remaining_labels(_labels(spark, sf), _assignments(spark, sf))


_WHITE = "c_custkey % 10 = 0"
_BLACK = "c_custkey % 17 = 0"
_THEMED = f"""
SELECT DISTINCT CASE r.bucket WHEN 'meal' THEN 'food_tour' WHEN 'accommodation' THEN 'stay' ELSE replace(r.bucket, 'attractions/', '') END AS theme,
       r.label, trim(regexp_replace(lower(r.label), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM ({_BUCKETS}) r JOIN cat_labels l ON l.label = r.label
WHERE r.bucket IN ('meal', 'accommodation', 'attractions/shopping', 'attractions/nightlife', 'attractions/nature') AND NOT ({_BLACK})
  AND ({_WHITE} OR (r.label NOT IN (SELECT label FROM ({_BUCKETS}) WHERE bucket = 'unique')
    AND NOT contains(r.label, 'Repair')
    AND (r.bucket <> 'attractions/shopping' OR NOT regexp_matches(r.label, 'supply|hardware|Wet_Market'))))
"""


def _theme_lists(spark, sf):
    rows = classify.resolve_buckets(_labels(spark, sf), _assignments(spark, sf))
    white = load(spark, sf, f"SELECT label FROM cat_labels WHERE {_WHITE}")
    black = load(spark, sf, f"SELECT label FROM cat_labels WHERE {_BLACK}")
    return classify.build_theme_lists(rows, white, black)


@query(_THEMED)
def build_theme_lists(spark, sf):
    return _theme_lists(spark, sf)


REPLIES = """
SELECT o_orderkey AS seq, 'order ' || CAST(o_orderkey AS STRING) AS asked,
  CASE o_orderkey % 5 WHEN 0 THEN 'Sure! ```json {"results":[{"label":"order ' || CAST(o_orderkey AS STRING) || '","buckets":["meal","nonsense"]}]} ``` done {x}'
   WHEN 1 THEN 'note {"results":[{"label":"other","buckets":["unique"]},{"buckets":["meal"]}]} end'
   WHEN 2 THEN 'no object here' WHEN 3 THEN '``` {"results":[{"label":"order ' || CAST(o_orderkey AS STRING) || '"}]}' ELSE '{"answer":1}' END AS reply
FROM orders
"""


@query("""SELECT o_orderkey AS seq, 'order ' || o_orderkey AS label, CASE o_orderkey % 5 WHEN 0 THEN 'meal' ELSE '' END AS buckets FROM orders WHERE o_orderkey % 5 IN (0, 1, 3)
          UNION ALL SELECT o_orderkey, 'other', 'unique' FROM orders WHERE o_orderkey % 5 = 1""")
def read_replies(spark, sf):
    df = load(spark, sf, REPLIES).withColumn("labels", F.array("asked"))
    return classify.read_replies(df).select("seq", "label", F.array_join("buckets", ",").alias("buckets"))


@query("""SELECT CAST(floor((row_number() OVER (ORDER BY md5(line), line) - 1) / 10) AS BIGINT) AS batch_no, md5(line) AS line_md5
          FROM (SELECT DISTINCT trim(l, ' ' || chr(9) || chr(13)) AS line FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE line <> ''""")
def distinct_line_batches(spark, sf):
    lines = load(spark, sf, "SELECT text FROM documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return classify.distinct_batches(lines).select("batch_no", F.md5("line").alias("line_md5"))


RAW = """
SELECT l.link, CASE WHEN l.p_partkey % 7 = 0 THEN l.p_name || ' hall' ELSE l.title || ' ' || CAST(l.p_partkey AS STRING) END AS title,
       l.complete_address, l.review_count, l.review_rating, 'dropped' AS cid, 'dropped' AS emails, l.p_brand AS descriptions,
       CASE WHEN l.p_partkey % 5 = 0 THEN 'tourist attraction,' ELSE '' END || lower(l.p_type) || ', ' || replace(l.p_name, ' ', ',') || CASE WHEN l.p_size % 3 = 0 THEN ',vegan restaurant' ELSE '' END AS categories,
       '6' || lpad(CAST(l.p_partkey AS STRING), 7, '0') AS phone, CASE WHEN l.p_size % 2 = 0 THEN '$$' ELSE '70-90' END AS price_range,
       '[{"title":"All","image":"https://img.example/' || CAST(l.p_partkey AS STRING) || '=w9"}]' AS images,
       '[{"name":"Offerings","options":[{"name":"Halal food","enabled":' || CASE WHEN l.p_size % 4 = 0 THEN 'true' ELSE 'false' END || '}]},{"name":"Crowd","options":[]}]' AS about,
       CASE WHEN l.p_partkey % 97 = 0 THEN NULL ELSE ((l.p_partkey * 7919) % 10500) / 1000.0E0 END AS latitude,
       CASE WHEN l.p_partkey % 97 = 0 THEN NULL ELSE 95.0E0 + ((l.p_partkey * 104729) % 26000) / 1000.0E0 END AS longitude,
       (l.p_partkey * 7919) % 100003 AS seq, l.p_partkey, l.p_type, l.p_name, l.p_size
FROM listings l
"""


def cleaned(source: str) -> str:
    return f"""
SELECT link, title AS name, CASE WHEN p_partkey % 5 = 0 THEN list_append(base, 'tourist attraction') ELSE kept END AS categories,
  '+656' || lpad(CAST(p_partkey AS STRING), 7, '0') AS phone, CAST(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 3 END AS INT) AS price_level,
  'https://img.example/' || p_partkey AS images, p_size % 4 = 0 AS halal_food, p_size % 3 = 0 AS vegan_options, latitude, longitude, review_rating
FROM (SELECT *, list_filter(base, lambda x: x NOT IN ('economy', 'red')) AS kept FROM (
  SELECT *, row_number() OVER (PARTITION BY title ORDER BY seq, link) AS name_rn,
         list_concat([lower(p_type), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)], CASE WHEN p_size % 3 = 0 THEN ['vegan restaurant'] ELSE [] END) AS base
  FROM ({source}) WHERE complete_address LIKE '%"country":%' AND review_count >= 50 AND review_rating >= 2.5))
WHERE name_rn = 1 AND (p_partkey % 5 = 0 OR p_type <> 'ECONOMY')
"""


EXCLUDED = "SELECT DISTINCT p_type AS token FROM part WHERE p_type = 'ECONOMY' UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part WHERE p_name LIKE 'red %'"


def _raw(spark, sf):
    return load(spark, sf, RAW).drop("p_partkey", "p_type", "p_name", "p_size")


@query(f"SELECT link, name, array_to_string(categories, ',') AS categories, phone, price_level, images, halal_food, vegan_options FROM ({cleaned(RAW)})")
def clean_listings(spark, sf):
    done = clean.clean_listings(_raw(spark, sf), load(spark, sf, EXCLUDED))
    return done.select("link", "name", F.array_join("categories", ",").alias("categories"), "phone", "price_level",
                       F.array_join("images", ",").alias("images"), "halal_food", "vegan_options")


LOADED = """
SELECT CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE 'https://maps.example/' || CAST(p_partkey AS STRING) END AS link, p_name AS name,
       '["' || lower(p_type) || '", "' || replace(p_name, ' ', '", "') || '"]' AS categories, CAST(p_size AS STRING) AS review_count,
       CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE CAST(p_partkey % 41 / 10.0E0 AS STRING) END AS review_rating,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size % 2 = 0 END AS halal_food, 1.5E0 AS latitude
FROM part
"""


@query(f"""SELECT 'https://maps.example/' || p_partkey AS google_map_link, p_name AS name, p_size AS review_count,
             CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 41) / 10.0E0 END AS review_rating, p_partkey % 3 <> 0 AND p_size % 2 = 0 AS halal_food,
             false AS vegan_options, true AS no_point, sha256('https://maps.example/' || p_partkey) AS id,
             CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'accommodation' WHEN 'plate' THEN 'meal' ELSE CASE WHEN p_type = 'PROMO' THEN 'meal,attraction' ELSE 'attraction' END END AS roles
           FROM part WHERE p_partkey % 41 <> 0""")
def derive_poi(spark, sf):
    done = poi.derive_poi(load(spark, sf, LOADED), role_map(spark, sf))
    return done.select("google_map_link", "name", "review_count", F.col("review_rating").cast("double").alias("review_rating"),
                       "halal_food", "vegan_options", F.col("point").isNull().alias("no_point"), "id",
                       F.array_join("poi_roles", ",").alias("roles"))


_TITLED = f"(SELECT * EXCLUDE (title_rn) FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY review_rating DESC NULLS LAST, link) AS title_rn FROM ({RAW})) WHERE title_rn = 1)"
_BRAND_KEPT = f"(SELECT * EXCLUDE (base_name, country, is_flagship, exceeds_threshold, n, rn, exempt) FROM ({grouped(_TITLED)}) WHERE {_KEPT})"
_PRUNED = f"SELECT * FROM {_BRAND_KEPT} WHERE link NOT IN (SELECT link FROM ({hits(_BRAND_KEPT)}) WHERE NOT is_flagship AND NOT is_exact AND rn > 1)"


@query(f"""SELECT c.link AS google_map_link, c.name, array_to_string(c.categories, ',') AS categories, c.phone, c.halal_food,
             CASE WHEN g.name IS NULL THEN CAST(c.price_level AS DOUBLE) WHEN g.price = '$$$' THEN 3.0E0 WHEN g.price IS NOT NULL THEN 4.0E0 END AS price_level,
             CASE WHEN g.images IS NULL THEN '' ELSE replace(g.images, ' , ', ',') || ',' END || c.images AS images,
             (SELECT coalesce(min(CASE WHEN b.kind = 'state' THEN b.id END), min(b.id)) FROM boxes b
              WHERE c.longitude BETWEEN b.x0 AND b.x1 AND c.latitude BETWEEN b.y0 AND b.y1) AS admin_area_id
           FROM ({cleaned(_PRUNED)}) c
           LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY seq, name) AS rn FROM guide WHERE phone IS NOT NULL) g
             ON g.phone = c.phone AND g.rn = 1""")
def prepare_places(spark, sf):
    done = prepare([_raw(spark, sf)], load(spark, sf, "SELECT pattern FROM patterns"), load(spark, sf, EXCLUDED), _guide(spark, sf),
                   role_map(spark, sf), areas(spark, sf), edges(spark, sf), persist=False)
    return done.select("google_map_link", "name", F.array_join("categories", ",").alias("categories"), "phone", "halal_food",
                       F.col("price_level").cast("double").alias("price_level"), F.array_join("images", ",").alias("images"), "admin_area_id")
