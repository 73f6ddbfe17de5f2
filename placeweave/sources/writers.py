"""Writing tables, word lists, indexes and snapshots."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions import geo

def write_csv(df: DataFrame, path: str) -> bool:
    """Write with a header, unless there are no rows. Lists are written as JSON text."""
    if df.isEmpty():
        return False
    flat = df.withColumns({
        f.name: F.to_json(f.name) for f in df.schema.fields
        if f.dataType.typeName() in ("array", "struct", "map")
    }) if any(f.dataType.typeName() in ("array", "struct", "map") for f in df.schema.fields) else df
    flat.write.options(header=True, quote='"', escape='"').csv(path)
    return True


def write_tokens(df: DataFrame, path: str, column: str = "token", ignore_case: bool = False) -> None:
    """Distinct lines in order: the part files, read in the order of their names, are sorted."""
    tokens = df.select(F.col(column).cast("string").alias("value")).distinct()
    order = [F.lower("value"), F.col("value")] if ignore_case else [F.col("value")]
    tokens.orderBy(*order).write.text(path)


def write_groups(df: DataFrame, path: str, group: str, item: str) -> None:
    """One folder per group with its distinct items in order, letter case aside: a range
    partitioning spreads a large group over files whose names are in order."""
    rows = df.select(group, F.col(item).cast("string").alias("value")).distinct()
    order = [F.col(group), F.lower("value"), F.col("value")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(group).text(path)


def write_index(df: DataFrame, path: str, group: str, item: str) -> None:
    """The same as JSON lines, with the other columns beside the item."""
    order = [F.col(group), F.lower(item), F.col(item)]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(group).json(path)


# Folders that one export may make.
EXPORT_BATCHES = 10_000


def write_batches(batches: DataFrame, path: str) -> None:
    """(batch_no, line) as Parquet, ranges of batches in files of the usual size."""
    batches.repartitionByRange("batch_no").sortWithinPartitions("batch_no").write.parquet(path)


def export_batches(batches: DataFrame, path: str) -> None:
    """One folder per batch of (batch_no, line), for a small number of batches: more than
    EXPORT_BATCHES are an error."""
    many = batches.select("batch_no").distinct().limit(EXPORT_BATCHES + 1).count()
    if many > EXPORT_BATCHES:
        raise ValueError(f"more than {EXPORT_BATCHES} batches; use write_batches")
    batches.repartition("batch_no").write.partitionBy("batch_no").text(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_assignments(assignments: DataFrame, path: str) -> None:
    """Add {label, buckets} lines to the log."""
    assignments.select("label", "buckets").write.mode("append").json(path)


def write_places(df: DataFrame, path: str, partition_by=("country_iso2",)) -> None:
    """The place table as Parquet, sorted by area inside the files, so that filters on the area
    skip row groups."""
    parts = [c for c in partition_by if c in df.columns]
    sort = [c for c in (*parts, "admin_area_id", "id") if c in df.columns]
    writer = df.sortWithinPartitions(*sort).write
    (writer.partitionBy(*parts) if parts else writer).parquet(path)


def write_places_by_curve(df: DataFrame, path: str, lon: str = "longitude", lat: str = "latitude", row_group: int = 8 << 20) -> None:
    """The place table as Parquet along a space-filling curve: files, and row groups of so many bytes
    in them, are patches of the map, whose bounds on longitude and latitude let a box skip the rest.
    Places without a point come first."""
    curve = geo.morton(lon, lat)
    laid = df.withColumn("_curve", curve).repartitionByRange("_curve").sortWithinPartitions("_curve").drop("_curve")
    laid.write.option("parquet.block.size", row_group).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder, jvm


def snapshot_versions(spark: SparkSession, base: str) -> list[int]:
    """Versions whose write was finished."""
    fs, folder, jvm = _fs(spark, base)
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("v=") and fs.exists(done):
            found.append(int(name[2:]))
    return sorted(found)


def write_snapshot(df: DataFrame, base: str) -> int:
    """Write the next version beside the old ones. Readers see it once it is complete, and the
    version the rows were read from is never overwritten."""
    versions = snapshot_versions(df.sparkSession, base)
    version = versions[-1] + 1 if versions else 0
    df.write.mode("overwrite").parquet(f"{base}/v={version}")
    return version


def read_snapshot(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    if version is None:
        version = snapshot_versions(spark, base)[-1]
    return spark.read.parquet(f"{base}/v={version}")
