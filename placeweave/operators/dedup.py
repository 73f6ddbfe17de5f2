"""Removing repeated listings: by title, by brand and country, by removal patterns."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.functions import text
from placeweave.operators.skew import first_per_group, lookup_join, small_values, with_totals


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All rows of all feeds; a column a feed lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def dedup_titles(*feeds: DataFrame, id_col: str = "link") -> DataFrame:
    """The best-rated listing of each title."""
    order = [F.col("review_rating").desc_nulls_last(), F.col(id_col)]
    return first_per_group(union_feeds(*feeds), "title", order)


def keep_first_by_name(df: DataFrame, *order: str, name: str = "name") -> DataFrame:
    return first_per_group(df, name, [F.col(c) for c in order])


def _best_first(id_col: str):
    """A struct whose smallest value is the most reviewed, then best rated, then lowest id."""
    return F.struct(
        F.col("review_count").isNull(), -F.col("review_count"),
        F.col("review_rating").isNull(), -F.col("review_rating"), F.col(id_col).alias("id"),
    )


def _with_brand(df: DataFrame) -> DataFrame:
    exceeds = (F.col("review_count") > 100) & (F.col("review_rating") >= 3.0)
    return df.withColumns({
        "country": text.country_tag("complete_address"),
        "base_name": text.base_name("title"),
        "is_flagship": text.is_flagship("title"),
        "exceeds_threshold": F.coalesce(exceeds, F.lit(False)),
    })


def _contested():
    """Rows that lose against a better one of their brand. Every other row is kept, whatever
    the size of its group, so the group is never needed as a whole."""
    return (
        F.col("country").isNotNull()
        & F.coalesce(~text.is_brand_exempt("base_name"), F.lit(False))
        & ~F.col("exceeds_threshold") & ~F.col("is_flagship")
    )


def _brand_marks(df: DataFrame, id_col: str) -> DataFrame:
    """Listings with `contested` and `is_best`; the best of a brand is one partial aggregate."""
    marked = _with_brand(df).withColumn("contested", _contested())
    best = (
        marked.filter("contested").groupBy("base_name", "country")
        .agg(F.min(_best_first(id_col))["id"].alias(id_col))
        .select(id_col, F.lit(True).alias("is_best"))
    )
    return marked.join(best, id_col, "left").withColumn("is_best", F.coalesce("is_best", F.lit(False)))


def dedup_brand_country(df: DataFrame, id_col: str = "link") -> DataFrame:
    """Per brand and country: all listings above the threshold, all flagships, and the best
    of the others. Short and exempt brand names, and unknown countries, are left alone. Only
    the contested listings are shuffled, and each task sends its best per brand at most."""
    marked = _with_brand(df)
    order = [F.col("review_count").desc_nulls_last(), F.col("review_rating").desc_nulls_last(), F.col(id_col)]
    best = first_per_group(marked.filter(_contested()), ["base_name", "country"], order)
    return marked.filter(~_contested()).unionByName(best).select(*df.columns)


def brand_country_log(df: DataFrame, id_col: str = "link") -> DataFrame:
    """What happened, and why, to each listing whose brand occurs twice or more in a country."""
    narrow = df.select(id_col, "title", "complete_address", "review_count", "review_rating")
    marked = _brand_marks(narrow, id_col).filter(
        F.col("country").isNotNull() & ~text.is_brand_exempt("base_name")
    )
    sized = with_totals(
        marked, ["base_name", "country"], id_col,
        partial={"brand_rows": F.count(F.lit(1))}, merge={"brand_rows": F.sum("brand_rows")},
    ).filter("brand_rows > 1")
    reason = (
        F.when(F.col("exceeds_threshold"), "exceeds threshold")
        .when(F.col("is_flagship"), "flagship")
        .when(F.col("is_best"), "best below-threshold")
        .otherwise("not best below-threshold")
    )
    removed = F.col("contested") & ~F.col("is_best")
    return sized.select(
        id_col, "title", "base_name", "country",
        F.when(removed, "REMOVE").otherwise("KEEP").alias("action"), reason.alias("reason"),
        "exceeds_threshold", "is_flagship",
    )


def country_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(text.country_tag("complete_address").alias("country")).agg(
        F.count(F.lit(1)).alias("listings"))


def duplicate_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that repeat an earlier value of a column, null being a value; one row per column."""
    def one(c):
        per_value = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        return per_value.agg(
            F.lit(c).alias("column_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
            F.count(F.lit(1)).alias("distinct_values"),
        ).withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_values"))
    return reduce(DataFrame.unionByName, [one(c) for c in columns])


# Characters in a piece of a title or pattern; shorter patterns are one piece.
PIECE = 3
_ROW = ["_row1", "_row2"]


def _keyed(df: DataFrame) -> DataFrame:
    """Rows with a key that tells them apart whatever they lack: two hashes over all columns, and over
    which of them are null. Rows that are equal in every column share it."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.concat(*[c.isNull().cast("string") for c in columns])
    return df.withColumns({"_row1": F.xxhash64(nulls, *columns), "_row2": F.xxhash64(F.lit(1), nulls, *columns)})


def _titles(df: DataFrame, id_col: str) -> DataFrame:
    """Distinct listings that a pattern may match, with the number of their copies."""
    found = _keyed(df).select(
        *_ROW, F.col(id_col).alias("_id"), "title", "review_count", "review_rating",
        text.country_tag("complete_address").alias("country")).filter("country IS NOT NULL AND title IS NOT NULL")
    return found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("haystack", F.upper("title"))


def _pieces(c, lengths):
    """Distinct pieces of a text that have one of these lengths."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    pieces = F.transform(at, lambda i: F.array(*[F.substring(c, i, F.lit(n)) for n in lengths]))
    return F.array_distinct(F.flatten(pieces))


def _own_pieces(needle):
    """All pieces of a pattern, each of which a title must hold; a short pattern is its only one."""
    last = F.greatest(F.length(needle) - (PIECE - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(needle, i, F.lit(PIECE))))


def rarest_pieces(held: DataFrame, needles: DataFrame) -> DataFrame:
    """Patterns with the one of their pieces that the fewest titles hold. A pattern with a piece that no
    title holds matches nothing and is left out. `held` has one row per title and piece."""
    own = needles.withColumn("piece", F.explode(_own_pieces(F.col("needle"))))
    wanted = own.select("piece").distinct()
    seen = lookup_join(held.select("piece"), wanted, "piece", "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    counted = own.join(seen, "piece", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.groupBy("pattern", "needle").agg(F.min(F.struct("n", "piece")).alias("rarest")).filter("rarest.n > 0").select(
        "pattern", "needle", "rarest.piece")


def _hits(df: DataFrame, patterns: DataFrame, id_col: str) -> DataFrame:
    """Distinct listings (with `copies`) and the patterns that their titles contain. A title is
    compared with a pattern only if it holds the pattern's rarest piece: row keys and pieces meet the
    patterns in an equi-join, and only titles that have such a piece are fetched."""
    needles = patterns.select(text.strip("pattern").alias("pattern")).filter("pattern <> ''").distinct().withColumn(
        "needle", F.upper("pattern"))
    lengths = [n for (n,) in small_values(needles.select(F.least(F.length("needle"), F.lit(PIECE)).alias("n")), "n")]
    titles = _titles(df, id_col)
    pieces = _pieces(F.col("haystack"), lengths) if lengths else F.array().cast("array<string>")
    held = titles.select(*_ROW, F.explode(pieces).alias("piece"))
    met = lookup_join(held, rarest_pieces(held, needles), "piece", _ROW).select(*_ROW, "pattern", "needle")
    found = titles.join(met, _ROW).filter(F.col("haystack").contains(F.col("needle")))
    return found.withColumns({
        "is_flagship": text.is_flagship("title"), "is_exact": F.lower("title") == F.lower("pattern")})


def _copied(df: DataFrame, times) -> DataFrame:
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).drop("_copy")


def pattern_matches(df: DataFrame, patterns: DataFrame, id_col: str = "link") -> DataFrame:
    """Listings whose title contains a pattern, letter case aside, with the verdict per pattern. A
    listing counts once for each of its rows, whether or not it has an id and whoever shares it."""
    return _copied(_hits(df, patterns, id_col), F.col("copies")).select(
        F.col("_id").alias(id_col), "title", "country", "pattern", "review_count", "review_rating", "is_flagship", "is_exact")


def _removals(df, patterns, keep_flagship, keep_exact, rank_by_reviews, id_col) -> DataFrame:
    """Hits with the number of copies that go under their pattern (`gone`). The best listing of a
    country and pattern loses no more than its further copies; it is found by a partial aggregate
    and joined by its row as well, so no pattern is too popular."""
    hits = _hits(df, patterns, id_col)
    losers = hits
    if keep_flagship:
        losers = losers.filter(~F.col("is_flagship"))
    if keep_exact:
        losers = losers.filter(~F.col("is_exact"))
    losers = losers.select(*_ROW, "_id", "country", "pattern", "copies")
    if not rank_by_reviews:
        return losers.withColumn("gone", F.col("copies"))
    first = F.struct(
        F.col("review_count").isNull(), -F.col("review_count"), F.col("review_rating").isNull(), -F.col("review_rating"),
        F.col("_id").isNull(), F.col("_id"), F.col("title"), *[F.col(c).alias(c) for c in _ROW])
    best = hits.groupBy("country", "pattern").agg(F.min(first).alias("b")).select(
        "country", "pattern", *[F.col("b")[c].alias(c) for c in _ROW], F.lit(1).alias("stays"))
    marked = losers.join(best, [*_ROW, "country", "pattern"], "left")
    return marked.withColumn("gone", F.col("copies") - F.coalesce("stays", F.lit(0))).filter("gone > 0").drop("stays")


def pattern_removals(df, patterns, keep_flagship=True, keep_exact=True, rank_by_reviews=True,
                     id_col: str = "link") -> DataFrame:
    """(id, country, pattern) of every removal."""
    gone = _removals(df, patterns, keep_flagship, keep_exact, rank_by_reviews, id_col)
    return _copied(gone, F.col("gone")).select(F.col("_id").alias(id_col), "country", "pattern")


def prune_by_patterns(df, patterns, keep_flagship=True, keep_exact=True, rank_by_reviews=True,
                      dry_run=False, id_col: str = "link") -> DataFrame:
    """Drop listings removed under any pattern, even if another pattern would keep them. Of equal rows
    that are the best of a pattern, and never worse than that, one stays."""
    if dry_run:
        return df
    removals = _removals(df, patterns, keep_flagship, keep_exact, rank_by_reviews, id_col)
    per_row = removals.groupBy(*_ROW).agg(F.max("gone").alias("gone"), F.max("copies").alias("copies"))
    keyed = _keyed(df)
    untouched = keyed.join(per_row.select(*_ROW), _ROW, "left_anti")
    if not rank_by_reviews:
        return untouched.select(*df.columns)
    one_stays = per_row.filter("gone < copies").select(*_ROW)
    return untouched.unionByName(keyed.join(one_stays, _ROW, "left_semi").dropDuplicates(_ROW)).select(*df.columns)


def removal_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows in, kept and removed."""
    kept = after.agg(F.count(F.lit(1)).alias("n")).scalar()
    return before.agg(F.count(F.lit(1)).alias("original")).select(
        "original", kept.alias("kept"), (F.col("original") - kept).alias("removed"))
