"""Validity rules: rows that pass, and rows that fail with the reasons."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.constants import EMAIL_PATTERN, ROLES, USERNAME_PATTERN


def matches(column: str, pattern: str) -> Column:
    return F.col(column).rlike("(?i)" + pattern)


def user_rules() -> dict[str, Column]:
    return {
        "email is null": F.col("email").isNotNull(),
        "email format": matches("email", EMAIL_PATTERN),
        "username is null": F.col("username").isNotNull(),
        "username format": matches("username", USERNAME_PATTERN),
    }


def poi_rules() -> dict[str, Column]:
    return {
        "google_map_link is null": F.col("google_map_link").isNotNull(),
        "name is null": F.col("name").isNotNull(),
    }


def role_rules() -> dict[str, Column]:
    return {"role is unknown": F.coalesce(F.col("role").isin(*ROLES), F.lit(False))}


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add `reasons`, the broken rules. As with a check constraint, an unknown (null) verdict
    passes."""
    broken = [F.when(F.coalesce(~rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    marked = with_reasons(df, rules)
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)
