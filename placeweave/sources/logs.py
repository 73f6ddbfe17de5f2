"""Logs of many small files, merged while readers and writers go on.

Writers append files to the log's folder. A merge writes the last entry of each label to a hidden
folder, and then publishes a list: that folder, and the files that went into it. Readers take the
latest list and whatever files it does not name, so they see either the small files or what came of
them. Files are only removed by `purge_log`, one merge later, when no reader can want them.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave import schemas
from placeweave.sources import manifests

_LISTS, _MERGED = "_merged/lists", "_merged/data"
_SEQ = T.StructType([T.StructField(n, t) for n, t in (
    ("written", T.TimestampType()), ("file", T.StringType()), ("block", T.LongType()), ("line_no", T.LongType()))])


def _files(spark: SparkSession, path: str) -> list[str]:
    """Names of the visible files in a log's folder."""
    fs, folder, _ = manifests.folder_of(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isFile()]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def _entries(lines: DataFrame, merged: bool) -> DataFrame:
    """Lines to (seq, label, buckets). Merged entries are older than all others."""
    written = F.timestamp_millis(F.lit(0)) if merged else F.col("_metadata.file_modification_time")
    read = lines.select(
        F.struct(written.alias("written"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("line_no")).alias("seq"),
        F.from_json("value", schemas.ASSIGNMENT).alias("a"))
    return read.filter("a.label IS NOT NULL").select(
        "seq", F.col("a.label").alias("label"), F.coalesce("a.buckets", F.array().cast("array<string>")).alias("buckets"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(seq, label, buckets) of a log of {label, buckets} lines. Lines that cannot be read are skipped;
    missing buckets are an empty list. Later files come after earlier ones, and in a file later lines
    after earlier ones, so that the last entry wins."""
    fs, folder, _ = manifests.folder_of(spark, path)
    if fs.exists(folder) and fs.getFileStatus(folder).isFile():
        return _entries(spark.read.text(path), False)
    state = manifests.load(spark, f"{path}/{_LISTS}")
    if state is None:
        return _entries(spark.read.text(path), False)
    fresh = [f"{path}/{n}" for n in _files(spark, path) if n not in set(state["files"])]
    old = _entries(spark.read.text(f"{path}/{state['data']}"), True)
    return old.unionByName(_entries(spark.read.text(fresh), False)) if fresh else old


def merge_log(spark: SparkSession, path: str) -> int | None:
    """Merge all files into one entry per label. Appends during it stay, as newer entries. None if
    there is nothing to merge; two merges at once are an error for the later one."""
    lists = f"{path}/{_LISTS}"
    state = manifests.load(spark, lists)
    known = set(state["files"]) if state else set()
    files = _files(spark, path)
    fresh = [n for n in files if n not in known]
    if not fresh:
        return None
    entries = _entries(spark.read.text([f"{path}/{n}" for n in fresh]), False)
    if state:
        entries = _entries(spark.read.text(f"{path}/{state['data']}"), True).unionByName(entries)
    data = f"{_MERGED}/{uuid.uuid4().hex}"
    entries.groupBy("label").agg(F.max_by("buckets", "seq").alias("buckets")).write.json(f"{path}/{data}")
    version = state["version"] + 1 if state else 0
    # Names that a purge has removed since are no longer there to be listed.
    manifests.publish(spark, lists, version, {"version": version, "data": data, "files": files})
    return version


def purge_log(spark: SparkSession, path: str) -> int:
    """Remove the files that the list before the last one has already replaced, and its merged data;
    the number of files."""
    lists = f"{path}/{_LISTS}"
    found = manifests.versions(spark, lists)
    if len(found) < 2:
        return 0
    before, now = (manifests.load(spark, lists, v) for v in found[-2:])
    fs, _, jvm = manifests.folder_of(spark, path)
    gone = [n for n in before["files"] if fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}"), False)]
    for v in found[:-1]:
        data = manifests.load(spark, lists, v)["data"]
        if data != now["data"]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{data}"), True)
    return len(gone)
