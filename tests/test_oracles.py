"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as registered
from catalog.registry import ORACLES, QUERIES
from check_oracles import rows_of
from paths import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(os.path.join(SF, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # No pairing of everything with everything, and no Python workers.
    for bad in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert bad not in plan
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", [
    "poi_candidates", "link_poi_areas", "link_area_parents", "pip_districts", "enrich_by_phone", "derive_roles",
    "derive_themes", "exclude_categories", "search_pois_list", "read_itineraries", "apply_itinerary_changes",
    "change_outcomes", "cascade_delete", "brand_country_log",
])
def test_query_matches_sql_without_broadcasts(spark, duck, name, no_literals_no_broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        compare(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_prune_without_broadcasts(spark, duck, monkeypatch):
    from placeweave.operators import skew

    monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)
    compare(spark, duck, "prune_by_patterns")


def test_rank_filters_cut_before_the_shuffle(spark):
    for name in ("dedup_titles", "clean_listings", "cap_per_area", "role_quota"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        # One cut on each side of the exchange.
        assert plan.count("WindowGroupLimit") >= 2, name


def test_filters_and_columns_reach_the_scan(spark):
    from catalog.places import plain_pois
    from placeweave.operators import itineraries as T

    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    df = spark.read.parquet(f"{SF}/orders.parquet").selectExpr(
        "o_orderkey AS id", "o_orderdate AS created_at", "o_orderdate AS updated_at", "o_custkey AS user_id", "o_orderstatus AS status",
        *[f"o_orderpriority AS {f}" for f in T.FIELDS])
    plan = T.list_itineraries(df, user=3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,3)" in plan and "EqualTo(o_orderstatus,active)" in plan and "TakeOrderedAndProject" in plan
    assert "o_totalprice" not in plan
    assert "p_retailprice" not in plain_pois(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_flagship_runs(spark):
    assert registered.entry(spark).count() > 0
