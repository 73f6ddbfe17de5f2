"""Queries of this subpackage and their SQL, by name."""

from functools import wraps

from placeweave.llm.common import ship_code

QUERIES = {}
ORACLES = {}


def shipped(fn):
    """A function of (spark, ...) whose tasks can import this package."""
    @wraps(fn)
    def call(spark, *args):
        ship_code(spark)
        return fn(spark, *args)
    return call


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = shipped(fn)
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
