"""Reading listings, guides, word lists, logs and boundaries, always with a schema."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave import schemas
from placeweave.functions.text import strip
from placeweave.sources.logs import read_log
from placeweave.sources.splits import read_csv_splits, read_json_objects


_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "enforceSchema": False}


def _csv(spark: SparkSession, path, positions: bool = False) -> DataFrame:
    """All columns as text, by the names in the header. A file whose header differs from the
    first one's is an error, not a silent shift of columns. With `positions` a column `seq` has
    the place of each row: its file, block and number."""
    raw = spark.read.options(**_CSV).csv(path)
    if not positions:
        return raw
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("line"))
    return raw.select("*", place.alias("seq"))


def read_csv(spark: SparkSession, path, schema=schemas.RAW_LISTING, recursive: bool = False,
             positions: bool = False, split: bool = False) -> DataFrame:
    """One file, a folder of files, or a whole tree. Columns are taken by name; one that is
    missing, or a value that does not fit its type, is null. `positions` adds `seq`. With `split`,
    and for trees, whose files may differ in their headers, large files are read by several tasks
    (`splits.py`); otherwise a task reads a file, and equal headers are required."""
    names = [f.name for f in schema.fields]
    if recursive or split:
        raw = read_csv_splits(spark, path, names, recursive, "*.csv" if recursive else None)
    else:
        raw = _csv(spark, path, positions)
    return raw.select(*[
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ], *(["seq"] if positions else []))


def read_guide(spark: SparkSession, path, positions: bool = False) -> DataFrame:
    """Guide files by glob pattern, all columns as text."""
    return _csv(spark, path, positions)


def read_tokens(spark: SparkSession, path) -> DataFrame:
    """Distinct trimmed non-empty lines, column `token`."""
    lines = spark.read.text(path).select(strip("value").alias("token"))
    return lines.filter("token <> ''").distinct()


def read_token_lists(spark: SparkSession, root: str) -> DataFrame:
    """(bucket, token) of all .txt files under a folder; the bucket is the file's name without the
    ending, behind `attractions/` if its folder has that name: `meal`, `attractions/nature`."""
    lines = spark.read.options(recursiveFileLookup=True, pathGlobFilter="*.txt").text(root)
    stem = F.element_at(F.split(F.url_decode("_metadata.file_path"), "/"), -1)
    folder = F.element_at(F.split(F.url_decode("_metadata.file_path"), "/"), -2)
    name = F.regexp_replace(stem, r"\.txt$", "")
    bucket = F.when(folder == "attractions", F.concat(F.lit("attractions/"), name)).otherwise(name)
    rows = lines.select(bucket.alias("bucket"), strip("value").alias("token"))
    return rows.filter("token <> ''").distinct()


def read_lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.options(pathGlobFilter="*.txt").text(path).withColumnRenamed("value", "line")


def read_assignments(spark: SparkSession, path) -> DataFrame:
    """A log of {label, buckets} lines with `seq`, the position in the log, whether or not it has been
    merged (`logs.py`)."""
    return read_log(spark, path)


def read_boundaries(spark: SparkSession, path) -> DataFrame:
    """Feature collections to rows for `load_areas`; the geometry stays text. A file is cut at its
    features by several tasks, and no row holds more than one."""
    found = read_json_objects(spark, path).select(F.from_json("value", schemas.FEATURE).alias("f"))
    features = found.filter("coalesce(f.type, 'Feature') = 'Feature' AND (f.properties IS NOT NULL OR f.geometry IS NOT NULL)")
    return features.select("f.properties.*", "f.geometry")


def read_table(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)
