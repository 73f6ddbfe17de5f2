"""Keyed changes to whole tables: a snapshot and its changes in, the next snapshot out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.operators.skew import first_per_group, lookup_join


def latest_changes(changes: DataFrame, keys, order) -> tuple[DataFrame, DataFrame]:
    """One change per key (the first in `order`), and the rejects: rows with a null key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    rejects = changes.filter(~whole).withColumn("reason", F.lit("key is null"))
    return first_per_group(changes.filter(whole), keys, order), rejects


def upsert(target: DataFrame, changes: DataFrame, keys, update_columns=None) -> DataFrame:
    """Insert new keys and update known ones; `changes` has one row per key. A known row takes
    the columns that `changes` has, or only `update_columns` of them, and keeps its others. A
    column that only `changes` has is added."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if update_columns is None:
        update_columns = [c for c in changes.columns if c not in keys]
        for c in update_columns:
            if c not in target.columns:
                target = target.withColumn(c, F.lit(None).cast(changes.schema[c].dataType))
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c not in keys],
                         F.lit(True).alias("_changed"))
    both = target.withColumn("_known", F.lit(True)).join(new, keys, "full")
    def pick(c):
        if c in keys:
            return F.col(c)
        if c not in changes.columns:
            return F.col(c)
        replace = F.col("_changed").isNotNull()
        if c not in update_columns:
            replace = F.col("_known").isNull()
        return F.when(replace, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*[pick(c) for c in target.columns])


def upsert_areas(target: DataFrame, changes: DataFrame) -> DataFrame:
    """Reloaded areas take their new level and parent and keep their id; since a reload brings
    no parent, parents are to be linked again afterwards."""
    return upsert(target, changes, ["name", "country_iso2", "kind"], ["admin_level", "parent_id"])


def replace_groups(target: DataFrame, changes: DataFrame, key: str, row_id) -> DataFrame:
    """Replace all rows of the groups that occur in `changes`, as the edges of reloaded areas."""
    changed = changes.select(key).distinct()
    return lookup_join(target, changed, key, row_id, "left_anti").unionByName(changes)


def add_pairs(target: DataFrame, pairs: DataFrame) -> DataFrame:
    """Insert pairs that are not there yet; every column is part of the key."""
    return target.unionByName(pairs).distinct()


def sync_delete(target: DataFrame, desired: DataFrame) -> DataFrame:
    """Keep only the pairs that are still wanted."""
    return target.join(desired.select(*target.columns).distinct(), target.columns, "left_semi")


def stale_pairs(target: DataFrame, desired: DataFrame) -> DataFrame:
    return target.join(desired.select(*target.columns).distinct(), target.columns, "left_anti")


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str, row_id: str) -> DataFrame:
    """Drop the children of deleted parents. A child without a parent stays; children of one
    parent are spread."""
    gone = deleted.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_gone", F.lit(True))
    own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("none:"), F.col(row_id).cast("string")))
    keyed = children.withColumn("_key", own)
    gone = gone.select(F.col(key).cast("string").alias("_key"), "_gone")
    return lookup_join(keyed, gone, "_key", row_id, "left").filter("_gone IS NULL").select(*children.columns)


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose parent is named but does not exist. Only the distinct parents named are looked
    up among all parents; the children of one parent are spread."""
    named = children.select(key).filter(F.col(key).isNotNull()).distinct()
    missing = named.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
    return lookup_join(children, missing, key, children.columns).select(*children.columns)


def fill_from(target: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """Update a column from a table with one row per key; a row not found keeps its value."""
    new = found.select(key, F.col(column).alias("_new"))
    return target.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).select(*target.columns)

