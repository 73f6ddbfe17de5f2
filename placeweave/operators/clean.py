"""Standardising raw listings and the restaurant guide, and joining the two by phone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave import constants as K
from placeweave.functions import media, text
from placeweave.operators.dedup import keep_first_by_name
from placeweave.operators.skew import first_per_group, lookup_join, small_values


def unify_strings(df: DataFrame) -> DataFrame:
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: text.unify_punctuation(c) for c in strings})


def keep_quality_rows(df: DataFrame) -> DataFrame:
    """Listings in the two countries with enough reviews and a fair rating."""
    here = F.col("complete_address").contains('"country":"SG"') | F.col("complete_address").contains('"country":"MY"')
    return df.filter(here & (F.col("review_count") >= 50) & (F.col("review_rating") >= 2.5))


def exclude_categories(df: DataFrame, excluded: DataFrame | None, id_col: str = "link") -> DataFrame:
    """Apply the list of excluded categories (column `token`). A tourist attraction keeps all
    its categories; a listing whose first category is excluded goes; elsewhere the category
    goes, and the listing with it when it was the last one. An empty list stays."""
    if excluded is None:
        return df
    c = F.col("categories")
    tokens = excluded.select(text.norm_token("token").alias("category")).distinct()
    words = small_values(tokens, "category")
    if words is not None:
        banned = [w for (w,) in words]
        df = df.withColumn("_left", F.filter(c, lambda x: ~x.isin(*banned)))
    else:
        hits = (
            lookup_join(df.select(id_col, F.explode(F.array_distinct(c)).alias("category")), tokens,
                        "category", id_col)
            .groupBy(id_col).agg(F.collect_set("category").alias("_banned"))
        )
        known = F.coalesce("_banned", F.array().cast("array<string>"))
        df = df.join(hits, id_col, "left").withColumn(
            "_left", F.filter(c, lambda x: ~F.array_contains(known, x))).drop("_banned")
    left = F.col("_left")
    untouched = c.isNull() | F.array_contains(c, "tourist attraction") | (F.size(left) == F.size(c))
    first_stays = F.get(c, F.lit(0)).eqNullSafe(F.get(left, F.lit(0)))
    return (
        df.filter(untouched | (first_stays & (F.size(left) > 0)))
        .withColumn("categories", F.when(untouched, c).otherwise(left))
        .drop("_left")
    )


def with_flags(df: DataFrame) -> DataFrame:
    """Eleven flags from the `about` options and the categories; the JSON is parsed once. A
    flag already true stays true."""
    parsed = df.withColumn("_options", media.enabled_options(media.about_sections("about")))
    flags = media.listing_flags(F.col("_options"), "categories")
    sticky = {
        n: (F.coalesce(F.col(n), F.lit(False)) | c) if n in df.columns else c for n, c in flags.items()
    }
    return parsed.withColumns(sticky).drop("_options")


def trim_about(df: DataFrame, removed=K.ABOUT_SECTIONS_REMOVED) -> DataFrame:
    """Drop the named sections in one pass; text that is not JSON stays as it is."""
    sections = media.about_sections("about")
    return df.withColumn("about", F.coalesce(F.to_json(media.keep_sections(sections, removed)), "about"))


def _file_order(df: DataFrame, *ids: str) -> list[str]:
    """What decides which of several rows is the first: the place in its file, where the reader
    has noted it in `seq`, and then the ids."""
    return [c for c in ("seq", *ids) if c in df.columns]


def standardise(raw: DataFrame) -> DataFrame:
    """Row-wise part of the cleaning, before the choice of one listing per name."""
    df = keep_quality_rows(unify_strings(raw)).drop(*K.SCRAPER_COLUMNS_DROPPED)
    return df.withColumnRenamed("title", "name").withColumns({
        "categories": text.category_tokens("categories"),
        "phone": text.phone_e164("phone"),
    })


def clean_listings(raw: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Raw listings to clean ones: one per name (the first read, if there is a `seq`), standard
    columns, flags, trimmed `about`."""
    df = standardise(raw)
    df = keep_first_by_name(df, *_file_order(df, "link")).drop("seq")
    df = df.withColumn("price_range", text.price_level("price_range")).withColumnRenamed(
        "price_range", "price_level")
    df = df.withColumn("categories", text.move_last("categories", "tourist attraction"))
    df = exclude_categories(df, excluded).withColumn("images", media.image_urls("images"))
    return trim_about(with_flags(df))


def rename_guide(raw: DataFrame) -> DataFrame:
    """Lower-case column names, no ID, and three columns under their common names. When a
    plain `price` column stands beside `pricerange`, the latter wins."""
    df = raw.toDF(*[c.lower() for c in raw.columns]).drop("id")
    if "pricerange" in df.columns:
        df = df.drop("price")
    return df.withColumnsRenamed({"websiteurl": "website", "phonenumber": "phone", "pricerange": "price"})


def clean_guide(raw: DataFrame) -> DataFrame:
    df = rename_guide(raw).withColumns({
        "phone": text.phone_e164("phone"), "images": text.comma_list("images"),
    })
    return keep_first_by_name(df, *_file_order(df, "phone", "price", "description"))


def enrich_from_guide(pois: DataFrame, guide: DataFrame, id_col: str = "link", guide_order=None) -> DataFrame:
    """Where the phone is in the guide: its price and description replace the listing's, even
    with null, and its images come first. Of several entries with a phone the first in the file
    counts, if the guide has a `seq`, and else the first by name. A missing phone matches nothing and is given a key
    of its own, so that missing phones do not meet in one task."""
    first = first_per_group(
        guide.filter("phone IS NOT NULL"), "phone", [F.col(c) for c in guide_order or _file_order(guide, "name")]
    ).select(
        F.col("phone").alias("_phone"), F.lit(True).alias("_hit"), F.col("price").alias("_price"),
        F.col("description").alias("_description"), F.col("images").alias("_images"),
    )
    keyed = pois.withColumn("_phone", F.coalesce("phone", F.concat(F.lit("none:"), F.col(id_col).cast("string"))))
    joined = lookup_join(keyed, first, "_phone", id_col, "left")
    hit = F.col("_hit").isNotNull()
    level = F.when(hit, text.price_level("_price")).otherwise(F.col("price_level"))
    return joined.withColumns({
        "price_level": level,
        "descriptions": F.when(hit, F.col("_description")).otherwise(F.col("descriptions")),
        "images": media.merge_images("_images", "images"),
    }).select(*pois.columns)


def category_catalogue(pois: DataFrame, exclude_keywords=()) -> DataFrame:
    """Distinct category tokens, less those that contain an excluded keyword."""
    tokens = pois.select(F.explode("categories").alias("category")).distinct()
    for word in exclude_keywords:
        tokens = tokens.filter(~F.lower("category").contains(word.lower()))
    return tokens


def about_catalogue(pois: DataFrame) -> DataFrame:
    """Distinct (section, option) pairs that occur enabled."""
    sections = pois.select(F.explode(media.about_sections("about")).alias("s")).select("s.*")
    options = sections.filter("name IS NOT NULL AND name <> ''").select(
        F.col("name").alias("section"), F.explode("options").alias("o"))
    return options.filter("o.enabled").select(
        "section", text.strip(F.coalesce("o.name", F.lit(""))).alias("option_name")).distinct()
