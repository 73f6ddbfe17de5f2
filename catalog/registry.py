"""The registered queries and their oracle SQL, by name."""

from catalog.base import with_tables

QUERIES = {}
ORACLES = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = with_tables(oracle)
        return fn
    return add
