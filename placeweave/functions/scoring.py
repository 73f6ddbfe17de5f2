"""Ranking scores of a place."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def quality_score(rating, reviews) -> Column:
    """A fifth from the rating, four fifths from the logarithm of the review count."""
    rating, reviews = F.col(rating), F.col(reviews)
    stars = F.coalesce(rating.cast("double") / 5.0, F.lit(0.0)) * 0.2
    volume = F.log(F.greatest(reviews, F.lit(1)).cast("double")) / math.log(100000)
    return stars + F.least(volume, F.lit(1.0)) * 0.8


def theme_match(roles, themes, wanted) -> Column:
    if not wanted:
        return F.lit(0)
    overlap = F.arrays_overlap(F.col(themes), F.array(*[F.lit(t) for t in wanted]))
    return F.when(F.array_contains(F.col(roles), "attraction") & F.coalesce(overlap, F.lit(False)), 1).otherwise(0)
