"""Numbered JSON files that say which files make up a table: each is complete once it is visible."""

import json
import uuid

from pyspark.sql import SparkSession


class TakenVersion(RuntimeError):
    """Another writer has published this version."""


def folder_of(spark: SparkSession, path: str):
    """(file system, Hadoop path, JVM) of a folder."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder, jvm


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, folder, _ = folder_of(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def publish(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Write a version aside and give it its name, which only one writer can do."""
    fs, folder, jvm = folder_of(spark, path)
    fs.mkdirs(folder)
    aside = jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}")
    final = jvm.org.apache.hadoop.fs.Path(folder, f"{version}.json")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        raise TakenVersion(f"{path}: version {version} exists")


def load(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """A version, or the latest; None if there is none."""
    if version is None:
        found = versions(spark, path)
        if not found:
            return None
        version = found[-1]
    fs, folder, jvm = folder_of(spark, path)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, f"{version}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
