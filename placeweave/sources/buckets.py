"""Keyed tables in hash buckets: a change rewrites the buckets that it touches, and no others.

A version is a manifest that names the folder of each bucket; buckets that a change leaves alone are
shared with the versions before, which stay readable. The manifest also remembers the last batch of
each stream, so that a batch that is sent again changes nothing.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.operators import tables
from placeweave.sources import manifests

BUCKETS = 64
_BUCKET = "_bucket"


def _bucket(keys, buckets: int):
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def _manifests(base: str) -> str:
    return f"{base}/manifests"


def _write(df: DataFrame, base: str, keys, buckets: int) -> dict[str, str]:
    """Write rows by bucket to a folder of their own; the folders of the buckets that have rows."""
    spark = df.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    df.withColumn(_BUCKET, _bucket(keys, buckets)).repartition(_BUCKET).sortWithinPartitions(_BUCKET, *keys).write.partitionBy(_BUCKET).parquet(f"{base}/{folder}")
    fs, path, _ = manifests.folder_of(spark, f"{base}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}


def create_table(df: DataFrame, base: str, keys, buckets: int = BUCKETS) -> int:
    """Version 0 of a table whose rows are told apart by `keys`."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    found = _write(df, base, keys, buckets)
    manifests.publish(df.sparkSession, _manifests(base), 0, {
        "version": 0, "keys": keys, "buckets": buckets, "schema": df.schema.json(), "folders": found, "batches": {}})
    return 0


def table_versions(spark: SparkSession, base: str) -> list[int]:
    return manifests.versions(spark, _manifests(base))


def _rows(spark: SparkSession, base: str, state: dict, buckets=None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(state["schema"]))
    folders = [f"{base}/{f}" for b, f in sorted(state["folders"].items()) if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    return _rows(spark, base, manifests.load(spark, _manifests(base), version))


def _change(base: str, changes: DataFrame, make, batch: tuple[str, int] | None) -> int:
    """Publish the next version: `make(rows, changes)` for the buckets that `changes` touch."""
    spark = changes.sparkSession
    state = manifests.load(spark, _manifests(base))
    if batch and state["batches"].get(batch[0], -1) >= batch[1]:
        return state["version"]
    keys, buckets = state["keys"], state["buckets"]
    # At most as many rows as there are buckets.
    touched = {r[0] for r in changes.select(_bucket(keys, buckets).alias("b")).distinct().collect()}
    folders = {b: f for b, f in state["folders"].items() if int(b) not in touched}
    if touched:
        new = make(_rows(spark, base, state, touched), changes)
        folders |= _write(new, base, keys, buckets)
    version = state["version"] + 1
    batches = state["batches"] | ({batch[0]: batch[1]} if batch else {})
    manifests.publish(spark, _manifests(base), version, state | {"version": version, "folders": folders, "batches": batches})
    return version


def upsert_table(base: str, changes: DataFrame, update_columns=None, batch: tuple[str, int] | None = None) -> int:
    """Insert or update by key; `changes` has one row per key. The table keeps its columns: others of
    `changes` are left out. `batch` (stream, number) is applied once."""
    state = manifests.load(changes.sparkSession, _manifests(base))

    def make(rows, new):
        out = tables.upsert(rows, new, state["keys"], update_columns)
        return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema.fields])

    return _change(base, changes, make, batch)


def delete_from_table(base: str, gone: DataFrame) -> int:
    """Drop the rows with the given keys."""
    keys = manifests.load(gone.sparkSession, _manifests(base))["keys"]
    return _change(base, gone.select(*keys).distinct(), lambda rows, g: rows.join(g, keys, "left_anti").select(*rows.columns), None)


def upsert_stream(stream: DataFrame, base: str, name: str, order, checkpoint: str):
    """Apply a stream of changes, batch by batch, until what is there now is read; the query. Of several
    changes to a key in one batch the first in `order` counts; rows with a null key are skipped."""
    return stream.writeStream.foreachBatch(lambda df, number: apply_batch(df, number, base, name, order)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_batch(df: DataFrame, number: int, base: str, name: str, order) -> int:
    """One batch of a stream: sent again, it changes nothing."""
    state = manifests.load(df.sparkSession, _manifests(base))
    latest, _ = tables.latest_changes(df, state["keys"], order)
    columns = [f["name"] for f in json.loads(state["schema"])["fields"]]
    return upsert_table(base, latest.select(*[c for c in latest.columns if c in columns]), batch=(name, number))
