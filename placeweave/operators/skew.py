"""Joins, counts and top-k that hold when one key owns a large share of the rows."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# A table is broadcast only after a bounded count has shown that it has at most this many rows and
# that they take at most this many bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# A word list becomes literals only up to this many entries.
LITERAL_ROWS = 5_000
# Rows of a key that a lookup leaves together; a key with more gets a salt for each such number.
KEY_ROWS = 4_096
# Least number of salts; a cluster with more shuffle partitions gets SALTS_PER_PARTITION for each.
SALTS = 64
SALTS_PER_PARTITION = 4
# Spark cuts rank filters before the shuffle up to this k (its default threshold).
_RANK_CUT = 1000


def salts_for(spark: SparkSession) -> int:
    """Enough salts for one key to reach nearly all tasks of a shuffle."""
    return max(SALTS, SALTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))


def salt(spread_by, salts: int = SALTS) -> Column:
    cols = [spread_by] if isinstance(spread_by, str) else spread_by
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def small_values(df: DataFrame, *columns: str, rows: int = LITERAL_ROWS):
    """Distinct rows of a word list as tuples, or None when there are more than `rows`. Lists
    that fit become literals of an expression, which needs no join and no shuffle."""
    found = df.select(*columns).distinct().limit(rows + 1).collect()
    return [tuple(r) for r in found] if len(found) <= rows else None


def fits_broadcast(small: DataFrame, rows: int) -> bool:
    """Has a table at most so many rows, and those at most BROADCAST_BYTES? It reads one row more
    than the bound at most, and measures text and nested columns by their JSON form."""
    if rows < 0:
        return False
    fixed = [f.name for f in small.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType))]
    wide = [c for c in small.columns if c not in fixed]
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in wide]))) if wide else F.lit(0)
    found = small.limit(rows + 1).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size.cast("long") + 8 * len(fixed)), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= rows and found["bytes"] <= BROADCAST_BYTES


def lookup_join(big: DataFrame, small: DataFrame, on, spread_by, how: str = "inner",
                small_rows: int | None = None, narrow: int = 1) -> DataFrame:
    """Join rows to a lookup table. Its rows are counted and measured, unless the caller knows a
    bound of a few narrow rows, and only a table within the limits (`narrow` times as many rows
    for a few numbers a row) is broadcast. Otherwise keys with more than KEY_ROWS rows are spread
    over salts, and the lookup is copied to the salts of its key: a hot key becomes many tasks,
    and copies are one for every KEY_ROWS pairs at most, beside the lookup itself."""
    on = [on] if isinstance(on, str) else list(on)
    most = BROADCAST_ROWS * narrow
    if fits_broadcast(small, most) if small_rows is None else small_rows <= most:
        return big.join(F.broadcast(small), on, how)
    # The hints keep Spark from broadcasting what was found too large: it knows of a cut table only
    # what it guessed of its inputs.
    salted, copies = salted_sides(big, small, on, spread_by)
    if how == "inner":
        # Spark holds the rows of a key on the right, which are bounded there, and streams the left.
        names = [*on, *[c for c in [*big.columns, *small.columns] if c not in on]]
        return copies.join(salted.hint("merge"), [*on, "__salt"]).select(*[f"`{c}`" for c in names])
    return salted.join(copies.hint("merge"), [*on, "__salt"], how).drop("__salt")


def salted_sides(big: DataFrame, small: DataFrame, on: list, spread_by) -> tuple[DataFrame, DataFrame]:
    """Both sides of a lookup with `__salt`: about KEY_ROWS rows of the big side share a key and a
    salt, and the lookup's rows are copied to all salts of their key."""
    # At most one row for every KEY_ROWS of the big side.
    hot = big.groupBy(*[F.col(f"`{c}`").alias(f"__on{i}") for i, c in enumerate(on)]).agg(
        F.ceil(F.count(F.lit(1)) / KEY_ROWS).cast("int").alias("__salts")).filter("__salts > 1")

    def counted(df):
        return df.join(F.broadcast(hot), F.expr(" AND ".join(f"`{c}` <=> __on{i}" for i, c in enumerate(on))), "left").drop(
            *[f"__on{i}" for i in range(len(on))])

    spread = [spread_by] if isinstance(spread_by, str) else spread_by
    salted = counted(big).withColumn(
        "__salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__salts")).cast("int"), F.lit(0))).drop("__salts")
    copies = counted(small).withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return salted, copies


def with_totals(df: DataFrame, keys, spread_by, partial: dict, merge: dict) -> DataFrame:
    """Attach per-key aggregates to every row without bringing a key's rows together.
    `partial` aggregates within (key, salt); `merge` combines those under the same names."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    salted = df.withColumn("__salt", salt(spread_by, salts_for(df.sparkSession)))
    parts = salted.groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in partial.items()])
    totals = parts.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])
    lookup = parts.select(*keys, "__salt").join(totals, keys)
    return salted.join(lookup, [*keys, "__salt"], "left").drop("__salt")


def top_per_group(df: DataFrame, keys, order, k: int, spread_by, out: str | None = None) -> DataFrame:
    """The first k rows of each group, numbered in `out`. Up to the rank threshold Spark keeps
    k rows per group in each task before it shuffles; above it, salted groups are cut first."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    name = out or "_rank"
    if k > _RANK_CUT:
        parts = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = df.withColumn("__salt", salt(spread_by, salts_for(df.sparkSession))).withColumn("_part", F.row_number().over(parts))
        df = df.filter(F.col("_part") <= k).drop("_part", "__salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(whole)).filter(F.col(name) <= k)
    return ranked if out else ranked.drop(name)


def first_per_group(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_per_group(df, keys, order, 1, spread_by=keys)


def _checkpoint_folder(df: DataFrame) -> str:
    """The cluster's checkpoint folder. Only a session that runs in one process may go without a named one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="placeweave-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the cluster's checkpoint folder and go on from there."""
    _checkpoint_folder(df)
    return df.checkpoint()


# Spark's setting that drops an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The same by a table of the folder. The shuffle files that it took are dropped at once, not when
    the driver happens to collect its garbage."""
    spark, path = df.sparkSession, f"{_checkpoint_folder(df)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
