"""Queries on trip plans and on keyed table changes."""

import datetime

from pyspark.sql import functions as F

from catalog.base import load
from catalog.registry import query
from placeweave.operators import checks, tables
from placeweave.operators import itineraries as T

AS_OF = datetime.datetime(2030, 1, 1)


def itineraries(spark, sf):
    return load(spark, sf, "SELECT * FROM itineraries")


def _day(c):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def _list_sql(where: str, limit: int, offset: int) -> str:
    return f"""SELECT id, title, destinations, status, strftime(updated_at, '%Y-%m-%d') AS updated_at, (SELECT count(*) FROM itineraries WHERE {where}) AS total_count
               FROM itineraries WHERE {where} ORDER BY itineraries.updated_at DESC NULLS FIRST, id LIMIT {limit} OFFSET {offset}"""


@query(_list_sql("status = 'active'", 20, 10))
def list_itineraries(spark, sf):
    page = T.list_itineraries(itineraries(spark, sf), offset=10)
    return page.select("id", "title", "destinations", "status", _day("updated_at"), "total_count")


@query(_list_sql("user_id = 21", 30, 0))
def list_user_itineraries(spark, sf):
    page = T.list_user_itineraries(itineraries(spark, sf), 21, status=None, limit=30)
    return page.select("id", "title", "destinations", "status", _day("updated_at"), "total_count")


def _read_sql(guest: str) -> str:
    return f"""SELECT request_id, access_status, CASE WHEN access_status = 'ok' THEN id END AS id, CASE WHEN access_status = 'ok' THEN title END AS title,
                 CASE WHEN access_status = 'ok' THEN plan END AS plan, CASE WHEN access_status = 'ok' THEN status END AS status
               FROM (SELECT r.request_id, i.id, i.title, i.plan, i.status, CASE WHEN i.id IS NULL THEN 'not_found'
                       WHEN i.user_id IS NOT NULL AND coalesce(r.user_id <> i.user_id, {guest}) THEN 'forbidden' ELSE 'ok' END AS access_status
                     FROM reads r LEFT JOIN itineraries i ON i.id = r.id)"""


def _read(spark, sf, policy):
    asked = load(spark, sf, "SELECT request_id, id, user_id FROM reads")
    return T.read_itineraries(asked, itineraries(spark, sf), policy).select(
        "request_id", "access_status", "id", "title", "plan", "status")


@query(_read_sql("true"))
def read_itineraries(spark, sf):
    return _read(spark, sf, "documented")


@query(_read_sql("false"))
def read_itineraries_as_coded(spark, sf):
    return _read(spark, sf, "as_coded")


def _fold_sql(select: str, guest: str, keep_missing: bool) -> str:
    """One request at a time per plan, as a recursive query."""
    def upserted(f, d):
        new = f"coalesce(r.{f}, s.{f})" if keep_missing else f"coalesce(r.{f}, {d})"
        return f"CASE WHEN s.here THEN {new} ELSE coalesce(r.{f}, {d}) END"

    def field(f, d, meta, update=True):
        create = "r.title" if f == "title" else f"coalesce(r.{f}, {d})"
        rules = [f"WHEN NOT good THEN s.{f}", f"WHEN r.op = 'create' THEN {create}", f"WHEN r.op = 'upsert' THEN {upserted(f, d)}",
                 f"WHEN r.op = 'update' THEN coalesce(r.{f}, s.{f})"]
        if meta:
            rules.append(f"WHEN r.op = 'update_meta' THEN coalesce(r.{f}, s.{f})")
        if f == "plan":
            rules.append("WHEN r.op = 'update_plan' THEN r.plan")
        return f"CASE {' '.join(rules)} ELSE s.{f} END"

    return f"""
WITH RECURSIVE reqs AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM changes),
fold(id, n, here, user_id, title, destinations, dates, plan, status, touched, seq, op, code) AS (
  SELECT q.id, CAST(0 AS BIGINT), i.id IS NOT NULL, i.user_id, i.title, i.destinations, i.dates, i.plan, i.status, false, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
  FROM (SELECT DISTINCT id FROM changes) q LEFT JOIN itineraries i ON i.id = q.id
  UNION ALL
  SELECT s.id, r.n,
    CASE WHEN r.op IN ('create', 'upsert') THEN true WHEN r.op = 'delete' THEN false ELSE s.here END,
    CASE WHEN r.op = 'delete' THEN NULL WHEN r.op IN ('create', 'upsert') AND NOT s.here THEN r.user_id WHEN r.op = 'claim' AND good THEN r.user_id ELSE s.user_id END,
    {field('title', "''", True)}, {field('destinations', "'[]'", False)}, {field('dates', "'{}'", True)}, {field('plan', "'{}'", False)},
    CASE WHEN NOT good THEN s.status WHEN r.op = 'create' OR (r.op = 'upsert' AND NOT s.here) THEN 'active' WHEN r.op = 'soft_delete' THEN 'deleted'
         WHEN r.op = 'update' THEN coalesce(r.status, s.status) ELSE s.status END,
    CASE WHEN r.op = 'delete' THEN false ELSE s.touched OR good END, r.seq, r.op, r.code
  FROM (SELECT *, code = 'ok' AS good FROM (
      SELECT s1.id AS sid, s1.n AS sn, r1.*, CASE
        WHEN r1.op = 'create' THEN CASE WHEN s1.here THEN 'duplicate_id' ELSE 'ok' END
        WHEN r1.op = 'upsert' THEN 'ok'
        WHEN r1.op = 'claim' AND r1.user_id IS NULL THEN 'invalid_user'
        WHEN NOT s1.here THEN 'not_found'
        WHEN r1.op = 'claim' THEN CASE WHEN s1.user_id IS NULL THEN 'ok' WHEN s1.user_id = r1.user_id THEN 'already_owned' ELSE 'forbidden' END
        WHEN r1.op IN ('update_meta', 'update_plan', 'soft_delete') AND s1.user_id IS NOT NULL AND coalesce(s1.user_id <> r1.user_id, {guest}) THEN 'forbidden'
        ELSE 'ok' END AS code
      FROM fold s1 JOIN reqs r1 ON r1.id = s1.id AND r1.n = s1.n + 1)) r
  JOIN fold s ON s.id = r.sid AND s.n = r.sn
),
final AS (SELECT * FROM fold f WHERE n = (SELECT max(n) FROM reqs x WHERE x.id = f.id))
{select}"""


_OUTCOME = "SELECT seq, id, op, code IN ('ok', 'already_owned') AS success, code AS error_code FROM fold WHERE n > 0"
_SNAPSHOT = """
SELECT id, user_id, title, destinations, dates, plan, status, CASE WHEN touched THEN '2030-01-01' ELSE strftime(updated_at, '%Y-%m-%d') END AS updated_at
FROM (SELECT f.id, f.user_id, f.title, f.destinations, f.dates, f.plan, f.status, f.touched, i.updated_at
      FROM final f LEFT JOIN itineraries i ON i.id = f.id WHERE f.here
      UNION ALL SELECT id, user_id, title, destinations, dates, plan, status, false, updated_at FROM itineraries WHERE id NOT IN (SELECT id FROM changes))"""


def _apply(spark, sf, **options):
    return T.apply_itinerary_changes(itineraries(spark, sf), load(spark, sf, "SELECT * FROM changes"), as_of=AS_OF, **options)


def _snapshot(df):
    return df.select("id", "user_id", "title", "destinations", "dates", "plan", "status", _day("updated_at"))


@query(_fold_sql(_OUTCOME, "true", False))
def change_outcomes(spark, sf):
    return _apply(spark, sf)[1]


@query(_fold_sql(_SNAPSHOT, "true", False))
def apply_itinerary_changes(spark, sf):
    return _snapshot(_apply(spark, sf)[0])


@query(_fold_sql(_SNAPSHOT, "false", True))
def apply_changes_as_coded_guests(spark, sf):
    return _snapshot(_apply(spark, sf, guest_policy="as_coded", preserve_missing=True)[0])


NEW_POIS = """
SELECT 'https://maps.example/' || CAST(l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 0 END AS STRING) AS google_map_link,
       'new ' || CAST(l_orderkey AS STRING) AS name, CAST(l_quantity AS INT) AS review_count, l_orderkey * 10 + l_linenumber AS version
FROM lineitem
"""


@query(f"""SELECT google_map_link, n.name, n.review_count, p.admin_area_id FROM (
             SELECT *, row_number() OVER (PARTITION BY google_map_link ORDER BY version DESC, name, review_count) AS rn FROM ({NEW_POIS})) n
           LEFT JOIN pois p USING (google_map_link) WHERE rn = 1
           UNION ALL SELECT google_map_link, name, review_count, admin_area_id FROM pois WHERE google_map_link NOT IN (SELECT google_map_link FROM ({NEW_POIS}))""")
def upsert_pois(spark, sf):
    """The changes bring no area: places keep the one they are linked to."""
    target = load(spark, sf, "SELECT google_map_link, name, review_count, admin_area_id FROM pois")
    changes, _ = tables.latest_changes(load(spark, sf, NEW_POIS), "google_map_link",
                                       [F.col("version").desc(), F.col("name"), F.col("review_count")])
    return tables.upsert(target, changes.drop("version"), "google_map_link")


AREAS_OLD = "SELECT 'old' || CAST(s_suppkey AS STRING) AS id, s_name AS name, 'MY' AS country_iso2, 'state' AS kind, 4 AS admin_level, 'C1' AS parent_id FROM supplier"
AREAS_NEW = """SELECT 'new' || CAST(c_custkey AS STRING) AS id, 'Supplier#' || lpad(CAST(c_custkey AS STRING), 9, '0') AS name, 'MY' AS country_iso2, 'state' AS kind,
    5 AS admin_level, CAST(NULL AS STRING) AS parent_id FROM customer"""


@query(f"""SELECT coalesce(o.id, n.id) AS id, coalesce(o.name, n.name) AS name, CASE WHEN n.id IS NULL THEN 4 ELSE 5 END AS admin_level,
             CASE WHEN n.id IS NULL THEN o.parent_id END AS parent_id FROM ({AREAS_OLD}) o FULL JOIN ({AREAS_NEW}) n ON o.name = n.name""")
def upsert_areas(spark, sf):
    return tables.upsert_areas(load(spark, sf, AREAS_OLD), load(spark, sf, AREAS_NEW)).select("id", "name", "admin_level", "parent_id")


PAIRS = "SELECT c_mktsegment || CAST(c_custkey % 900 AS STRING) AS category, CASE c_nationkey % 2 WHEN 0 THEN 'meal' ELSE 'attraction' END AS role FROM customer"
DESIRED = "SELECT c_mktsegment || CAST(c_custkey % 700 AS STRING) AS category, CASE c_nationkey % 2 WHEN 0 THEN 'meal' ELSE 'attraction' END AS role FROM customer"


@query(f"SELECT DISTINCT category, role FROM ({PAIRS}) UNION SELECT category, role FROM ({DESIRED})")
def add_pairs(spark, sf):
    return tables.add_pairs(load(spark, sf, PAIRS), load(spark, sf, DESIRED))


@query(f"SELECT DISTINCT category, role FROM ({PAIRS}) WHERE (category, role) IN (SELECT category, role FROM ({DESIRED}))")
def sync_delete(spark, sf):
    return tables.sync_delete(load(spark, sf, PAIRS).distinct(), load(spark, sf, DESIRED))


@query(f"SELECT DISTINCT category, role FROM ({PAIRS}) EXCEPT SELECT category, role FROM ({DESIRED})")
def stale_pairs(spark, sf):
    return tables.stale_pairs(load(spark, sf, PAIRS).distinct(), load(spark, sf, DESIRED))


DELETED = "SELECT c_custkey AS user_id FROM customer WHERE c_acctbal < 0"


@query(f"SELECT id, user_id FROM itineraries WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM ({DELETED}))")
def cascade_delete(spark, sf):
    return tables.cascade_delete(itineraries(spark, sf), load(spark, sf, DELETED), "user_id", "id").select("id", "user_id")


@query(f"SELECT id, user_id FROM itineraries WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def orphan_rows(spark, sf):
    users = load(spark, sf, "SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0")
    return tables.orphans(itineraries(spark, sf), users, "user_id").select("id", "user_id")


@query("""SELECT id, array_to_string(list_filter([
             CASE WHEN email IS NULL THEN 'email is null' END, CASE WHEN NOT regexp_matches(email, '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}$', 'i') THEN 'email format' END,
             CASE WHEN username IS NULL THEN 'username is null' END, CASE WHEN NOT regexp_matches(username, '^[a-z0-9_]{3,30}$', 'i') THEN 'username format' END],
             lambda x: x IS NOT NULL), ',') AS reasons FROM users""")
def validity_split(spark, sf):
    valid, rejects = checks.split_valid(load(spark, sf, "SELECT * FROM users"), checks.user_rules())
    return valid.select("id", F.lit("").alias("reasons")).unionByName(
        rejects.select("id", F.array_join("reasons", ",").alias("reasons")))
