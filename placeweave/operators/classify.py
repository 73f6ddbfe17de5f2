"""Sorting category labels into buckets, roles and themes, and the lists made from them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave import schemas
from placeweave.constants import BLOCK_TERMS, BUCKETS, ROLES, THEME_POLICY, THEMES
from placeweave.functions import text


def read_replies(replies: DataFrame) -> DataFrame:
    """Classifier replies (seq, reply, labels) to assignments (seq, label, buckets): code fences and
    text around the JSON object go, unknown buckets go, and a label of the batch that the
    reply leaves out gets an empty list. A reply that cannot be read assigns nothing."""
    fenced = F.regexp_extract("reply", r"(?s)```(?:json)?(.*?)(?:```|$)", 1)
    body = F.when(F.col("reply").contains("```"), fenced).otherwise(F.col("reply"))
    read = replies.withColumn("parsed", F.from_json(F.regexp_extract(body, r"(?s)\{.*\}", 0), schemas.REPLY))
    read = read.filter("parsed.results IS NOT NULL")
    allowed = F.array(*[F.lit(b) for b in (*BUCKETS, "unique", "exclude")])
    answers = read.select("seq", F.posexplode("parsed.results").alias("pos", "r")).filter(
        "r.label IS NOT NULL AND r.label <> ''")
    answers = answers.select(
        "seq", "pos", F.col("r.label").alias("label"),
        F.filter(F.coalesce("r.buckets", F.array().cast("array<string>")),
                 lambda b: F.array_contains(allowed, b)).alias("buckets"))
    asked = read.select("seq", F.lit(-1).alias("pos"), F.explode("labels").alias("label"),
                        F.array().cast("array<string>").alias("buckets"))
    every = answers.unionByName(asked)
    last = F.max_by("buckets", "pos").alias("buckets")
    return every.groupBy("seq", "label").agg(last)


def last_assignments(assignments: DataFrame) -> DataFrame:
    """The last entry of each label in the log (seq, label, buckets)."""
    return assignments.groupBy("label").agg(F.max_by("buckets", "seq").alias("buckets"))


def remaining_labels(labels: DataFrame, assignments: DataFrame) -> DataFrame:
    """Labels not classified yet."""
    return labels.select("label").distinct().join(assignments.select("label").distinct(), "label", "left_anti")


def resolve_buckets(labels: DataFrame, assignments: DataFrame) -> DataFrame:
    """(bucket, label) rows. A label in some bucket is not excluded; one in none is excluded if
    the classifier said so and unique otherwise; one it called unique is unique besides."""
    raw = labels.select(text.strip("label").alias("label")).filter("label <> ''").distinct()
    both = raw.withColumn("raw", F.lit(True)).join(last_assignments(assignments), "label", "full")
    given = F.coalesce("buckets", F.array().cast("array<string>"))
    matched = F.array_intersect(F.array(*[F.lit(b) for b in BUCKETS]), given)
    excluded = F.array_contains(given, "exclude") & (F.size(matched) == 0)
    unique = F.array_contains(given, "unique") | (
        F.coalesce("raw", F.lit(False)) & (F.size(matched) == 0) & ~F.array_contains(given, "exclude"))
    buckets = F.concat(
        matched,
        F.when(excluded, F.array(F.lit("exclude"))).otherwise(F.array().cast("array<string>")),
        F.when(unique, F.array(F.lit("unique"))).otherwise(F.array().cast("array<string>")),
    )
    return both.select(F.explode(buckets).alias("bucket"), "label")


def label_index(bucket_rows: DataFrame) -> DataFrame:
    """Label to its sorted buckets; a label has at most one row per bucket."""
    return bucket_rows.filter(F.col("bucket").isin(*BUCKETS)).groupBy("label").agg(
        F.sort_array(F.collect_set("bucket")).alias("buckets"))


def build_theme_lists(bucket_rows: DataFrame, whitelist: DataFrame, blacklist: DataFrame,
                      policy: dict = THEME_POLICY, block_terms=BLOCK_TERMS, default_buckets=BUCKETS) -> DataFrame:
    """(theme, label, slug): labels in one of a theme's buckets that are not blacklisted, not
    excluded, not unique and not blocked by a term; the whitelist lifts the last two. A theme without
    buckets of its own has the default ones."""
    index = label_index(bucket_rows)
    def words(df, name):
        return df.select(text.strip("label").alias("label")).distinct().withColumn(name, F.lit(True))
    side = {
        "white": words(whitelist, "white"), "black": words(blacklist, "black"),
        "gone": words(bucket_rows.filter("bucket = 'exclude'"), "gone"),
        "rare": words(bucket_rows.filter("bucket = 'unique'"), "rare"),
    }
    for table in side.values():
        index = index.join(table, "label", "left")
    index = index.na.fill(False, list(side))
    plain = F.replace(F.lower("label"), F.lit("_"), F.lit(" "))
    rows = index.filter("NOT black AND NOT gone AND (NOT rare OR white)")
    themes = []
    for theme, (buckets, extra) in policy.items():
        blocked = plain.rlike("(?iU)(?:" + "|".join([*block_terms, *extra]) + ")")
        allowed = F.arrays_overlap("buckets", F.array(*[F.lit(b) for b in buckets or default_buckets]))
        themes.append(F.when(allowed & (F.col("white") | ~blocked), F.lit(theme)))
    return rows.select(F.explode(F.array_compact(F.array(*themes))).alias("theme"), "label").withColumn(
        "slug", text.slug("label"))


def manage_groups(categories: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (bucket, token) cut to the known categories, and the categories in no group."""
    known = categories.select("category").distinct()
    inside = groups.select("bucket", F.col("token").alias("category")).distinct().join(known, "category", "left_semi")
    rest = known.join(inside.select("category").distinct(), "category", "left_anti")
    return inside.select("bucket", "category"), rest


_ROLE_BUCKETS = {"meal": "meal", "accommodation": "accommodation", "accomodation": "accommodation", "unique": "attraction"}


def build_role_map(token_lists: DataFrame) -> DataFrame:
    """(category, role) pairs of token lists (bucket, token)."""
    role = F.when(F.col("bucket").startswith("attractions/"), "attraction")
    for bucket, name in _ROLE_BUCKETS.items():
        role = role.when(F.col("bucket") == bucket, name)
    pairs = token_lists.select(text.norm_token("token").alias("category"), role.alias("role"))
    return pairs.filter(F.col("role").isin(*ROLES) & (F.col("category") != "")).distinct()


def build_theme_map(token_lists: DataFrame) -> DataFrame:
    """(theme, category) pairs of the ten theme lists."""
    theme = F.regexp_extract("bucket", "^attractions/(.*)$", 1)
    pairs = token_lists.select(theme.alias("theme"), text.norm_token("token").alias("category"))
    return pairs.filter(F.col("theme").isin(*THEMES) & (F.col("category") != "")).distinct()


# Hex digits that tell buckets apart: 65,536 of them hold a million rows each of 65 billion, and their
# table is small. The most that keep it so.
DIGITS, MOST_DIGITS = 4, 5


def numbered(df: DataFrame, key: str, size: int, digits: int = DIGITS) -> DataFrame:
    """Add `batch_no`: rows with unique keys in batches of `size`. The order is that of the
    keys' hashes, whose first hex digits split them into even buckets: the buckets, at most
    16 ** digits rows, are counted, and each is numbered on its own from where the one before
    it ends. The number of digits changes no result."""
    if not 1 <= digits <= MOST_DIGITS:
        raise ValueError(f"digits must be 1 to {MOST_DIGITS}")
    hashed = df.withColumn("_hash", F.md5(F.col(key).cast("string")))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, digits))
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_skip"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", key))
    placed = hashed.withColumn("_place", place).join(F.broadcast(offsets), "_bucket")
    batch = F.floor((F.col("_skip") + F.col("_place") - 1) / size)
    return placed.select(batch.alias("batch_no"), *df.columns)


def distinct_batches(lines: DataFrame, n: int = 10, digits: int = DIGITS) -> DataFrame:
    """(batch_no, line): distinct trimmed lines, n to a batch."""
    clean = lines.select(text.strip("line").alias("line")).filter("line <> ''").distinct()
    return numbered(clean, "line", n, digits)
