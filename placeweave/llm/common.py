"""Shared helpers: row keys, tables in the shared folder, connected components."""

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Order of a missing id: after every other.
LAST_ID = (1 << 63) - 1


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Let executors import this package, unless their PYTHONPATH has it: once per application."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(":") or context.applicationId in _SHIPPED:
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="placeweave-code-"), "placeweave"), "zip", root, "placeweave")
    context.addPyFile(made)
    _SHIPPED.add(context.applicationId)


def order_id(column: str) -> Column:
    """The id by which rows are compared; a null id counts as the largest."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="placeweave-llm-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


# Folders of `temporary`, the innermost last.
_INSIDE: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    return f"{_INSIDE[-1] if _INSIDE else shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def temporary(spark: SparkSession):
    """What is written inside goes to a folder that is removed at the end: whatever is to stay is
    written to a path named before."""
    folder = scratch(spark, "temporary")
    _INSIDE.append(folder)
    try:
        yield
    finally:
        _INSIDE.remove(folder)
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Spark's setting that drops an execution's shuffle files when it ends: what is written needs
# them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Cut lineage: write the rows as a table in the shared folder and go on from there."""
    spark = df.sparkSession
    path = path or scratch(spark, what)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove a table made by `written` that no later step reads."""
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        remove(df.sparkSession, folder)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and, for each, the smallest node it is connected to."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches):
    """Replace the edges of a batch by a star of each of its components."""
    for batch in batches:
        nodes, low = roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        keep = nodes != low
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(low[keep])], names=["v", "m"])


def components(edges: DataFrame) -> DataFrame:
    """Rows (v, m): each node that has an edge and is not the smallest of its component, with
    the smallest. `edges` has two long columns without nulls.

    Rounds of joining every node to its smallest neighbour (larger neighbours first, then
    smaller ones) until nothing changes. Each round is aggregates and joins over links, written
    to the shared folder; no component is ever gathered."""
    a, b = edges.columns
    state = written(
        edges.select(F.col(a).alias("v"), F.col(b).alias("m")).filter("v <> m").mapInArrow(_contract, "v long, m long"), "links")
    seen = None
    while True:
        both = state.unionByName(state.select(F.col("m").alias("v"), F.col("v").alias("m")))
        lowest = both.groupBy("v").agg(F.least("v", F.min("m")).alias("low"))
        large = both.filter("m > v").join(lowest, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()
        large = written(large, "links")
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        moved = large.join(least, "v").filter("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        new = written(moved.unionByName(least.select("v", F.col("low").alias("m"))).distinct(), "links")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        drop_written(large)
        drop_written(state)
        if now == seen:
            return new
        state, seen = new, now
