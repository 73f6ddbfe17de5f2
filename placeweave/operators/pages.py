"""Pages far down an ordered table, without sorting what comes before them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows that are sorted at the end, at most (unless all of them are equal), and ranges that each round
# of counting makes.
ROWS, RANGES = 50_000, 64


def deep_page(df: DataFrame, order: list, unique: str, offset: int, limit: int, rows: int = ROWS) -> tuple[DataFrame, int]:
    """(page, total): `limit` rows after the first `offset` in the given order, and the number of all.

    `order` are ascending expressions, the last of which tells all rows apart; `unique` names its
    column. Rounds of counting narrow the rows down to those that a page can hold: a few rows with
    the smallest hashes bound ranges of the sort key, and one aggregate counts the rows in each.
    Only the ranges that hold the page are looked at further, and sorted in the end."""
    names = [f"_k{i}" for i in range(len(order))]
    inside = df.withColumn("_key", F.struct(*[c.alias(n) for c, n in zip(order, names, strict=True)]))
    total, skip = None, offset
    while True:
        bounds = inside.select("_key", F.xxhash64(F.col(unique).cast("string"), F.lit(skip)).alias("_h")).orderBy("_h", "_key").limit(RANGES - 1)
        # RANGES - 1 keys at most; they become literals.
        found = [r["_key"] for r in bounds.agg(F.sort_array(F.collect_list("_key")).alias("c")).select(F.explode("c").alias("_key")).collect()]
        cuts = F.array(*[_literal(c, inside) for c in found])
        place = F.size(F.filter(cuts, lambda c: c < F.col("_key"))) if found else F.lit(0)
        counted = inside.groupBy(place.alias("_range")).agg(F.count(F.lit(1)).alias("n")).collect()
        counts = {r["_range"]: r["n"] for r in counted}
        here = sum(counts.values())
        total = here if total is None else total
        first = last = None
        seen, before = 0, 0
        for k in sorted(counts):
            if first is None and seen + counts[k] > skip:
                first, before = k, seen
            if seen < skip + limit:
                last = k
            seen += counts[k]
        if first is None or limit <= 0:
            return df.limit(0), total
        kept = sum(n for k, n in counts.items() if first <= k <= last)
        low = found[first - 1] if first > 0 else None
        high = found[last] if last < len(found) else None
        if kept < here:
            if low is not None:
                inside = inside.filter(F.col("_key") > _literal(low, inside))
            if high is not None:
                inside = inside.filter(F.col("_key") <= _literal(high, inside))
            skip -= before
        if kept <= rows or kept == here:
            return inside.orderBy("_key").offset(skip).limit(limit).drop("_key"), total


def _literal(row, df: DataFrame):
    fields = df.schema["_key"].dataType.fields
    return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in fields])
