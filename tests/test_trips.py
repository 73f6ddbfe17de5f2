"""Trip plans: the set-based fold against one request at a time."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from placeweave.operators import itineraries as T

SNAP = "id string, created_at timestamp, updated_at timestamp, user_id int, " + ", ".join(f"{f} string" for f in T.FIELDS) + ", status string"
REQ = "seq long, id string, op string, user_id int, " + ", ".join(f"{f} string" for f in T.FIELDS) + ", status string, ts timestamp"
T0 = datetime.datetime(2020, 1, 1)


def stamp(n):
    return T0 + datetime.timedelta(seconds=n)


def default(field):
    return "" if field == "title" else "[]" if field in T.LISTS else "{}"


def one_at_a_time(snapshot, requests, guests_pass, preserve):
    plans = {p["id"]: dict(p) for p in snapshot}
    outcomes = {}
    for r in sorted(requests, key=lambda r: r["seq"]):
        p, op, code = plans.get(r["id"]), r["op"], "ok"
        stranger = p is not None and p["user_id"] is not None and (
            p["user_id"] != r["user_id"] if r["user_id"] is not None else not guests_pass)
        new = {f: r[f] for f in T.FIELDS}
        if op == "create":
            if p is not None:
                code = "duplicate_id"
            else:
                plans[r["id"]] = {"id": r["id"], "created_at": r["ts"], "updated_at": r["ts"], "user_id": r["user_id"], "status": "active",
                                  **{f: v if v is not None or f == "title" else default(f) for f, v in new.items()}}
        elif op == "upsert":
            filled = {f: default(f) if v is None else v for f, v in new.items()}
            if p is None:
                plans[r["id"]] = {"id": r["id"], "created_at": r["ts"], "updated_at": r["ts"], "user_id": r["user_id"], "status": "active", **filled}
            else:
                p.update({f: v for f, v in new.items() if v is not None} if preserve else filled, updated_at=r["ts"])
        elif op == "claim" and r["user_id"] is None:
            code = "invalid_user"
        elif op not in T.OPS:
            code = "unknown_op"
        elif p is None:
            code = "not_found"
        elif op == "delete":
            del plans[r["id"]]
        elif op == "update":
            p.update({f: v for f, v in [*new.items(), ("status", r["status"])] if v is not None}, updated_at=r["ts"])
        elif op == "claim":
            if p["user_id"] is None:
                p.update(user_id=r["user_id"], updated_at=r["ts"])
            else:
                code = "already_owned" if p["user_id"] == r["user_id"] else "forbidden"
        elif stranger:
            code = "forbidden"
        elif op == "update_meta":
            p.update({f: new[f] for f in T.META_FIELDS if new[f] is not None}, updated_at=r["ts"])
        elif op == "update_plan":
            p.update(plan=new["plan"], updated_at=r["ts"])
        else:
            p.update(status="deleted", updated_at=r["ts"])
        outcomes[r["seq"]] = code
    return plans, outcomes


def random_case(seed, n, share=0.5):
    rng = random.Random(seed)
    snapshot = [{"id": f"p{i}", "created_at": T0, "updated_at": T0, "user_id": rng.choice([None, 1, 2]),
                 **{f: rng.choice([None, f"old {f}"]) for f in T.FIELDS}, "status": "active"} for i in range(6)]
    requests = []
    for seq in range(n):
        requests.append({
            # One plan gets half of all requests, or all, and one number lies far from the others.
            "seq": seq * 3 + 5 + (10 ** 12 if seq == n - 1 else 0), "id": "p0" if rng.random() < share else f"p{rng.randint(1, 9)}",
            "op": rng.choice([*T.OPS, "claim", "update_meta", "nonsense"]), "user_id": rng.choice([None, 1, 2, 3]),
            **{f: rng.choice([None, f"{f} {seq}"]) for f in T.FIELDS}, "status": rng.choice([None, "archived"]), "ts": stamp(seq)})
    return snapshot, requests


@pytest.mark.parametrize("seed, n, guests, preserve, chunks, share", [
    (1, 400, "documented", False, 16, 0.5), (2, 400, "as_coded", True, 1, 0.5), (3, 60, "documented", True, 256, 0.5),
    (4, 12, "as_coded", False, 5, 0.5), (5, 400, "documented", False, None, 1.0)])
def test_changes_equal_one_at_a_time(spark, seed, n, guests, preserve, chunks, share):
    snapshot, requests = random_case(seed, n, share)
    snap = spark.createDataFrame([tuple(p[c] for c in T.COLUMNS) for p in snapshot], SNAP)
    names = [f.split()[0] for f in REQ.split(", ")]
    reqs = spark.createDataFrame([tuple(r[c] for c in names) for r in requests], REQ)
    plans, codes = one_at_a_time(snapshot, requests, guests == "as_coded", preserve)
    after, outcomes = T.apply_itinerary_changes(snap, reqs, guest_policy=guests, preserve_missing=preserve, chunks=chunks)
    rows = outcomes.collect()
    assert {r["seq"]: r["error_code"] for r in rows} == codes and len(rows) == n
    assert all(r["success"] == (r["error_code"] in ("ok", "already_owned")) for r in rows)
    assert {r["id"]: tuple(r[c] for c in T.COLUMNS) for r in after.collect()} == {
        k: tuple(p[c] for c in T.COLUMNS) for k, p in plans.items()}


def test_busy_plans_are_dealt_over_ranges(spark):
    reqs = spark.range(1000).select(
        F.when(F.col("id") == 999, 10 ** 12).otherwise(F.col("id")).alias("seq"), F.lit("p").alias("id"), F.lit("update").alias("op"), F.lit(1).alias("user_id"))
    reqs = reqs.withColumn("seq", F.col("seq").cast("long"))
    lives = T._with_lives(reqs, 8)
    scans = lives._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in scans and "Range (" not in scans  # the ranges are read from what was written
    snap = spark.createDataFrame([], SNAP)
    after, outcomes = T.apply_itinerary_changes(snap, reqs, as_of=T0)
    assert {r["error_code"] for r in outcomes.select("error_code").distinct().collect()} == {"not_found"} and after.count() == 0


def test_ids_and_time_are_filled_in(spark):
    snap = spark.createDataFrame([], SNAP)
    reqs = spark.createDataFrame([(1, None, "create", 7, "t"), (2, None, "update", 7, "t"), (3, None, "claim", None, None), (4, None, "upsert", 7, "t")],
                                 "seq long, id string, op string, user_id int, title string")
    after, outcomes = T.apply_itinerary_changes(snap, reqs, as_of=T0)
    row = after.collect()
    assert len(row) == 1 and row[0]["title"] == "t" and row[0]["destinations"] == "[]" and row[0]["created_at"] == T0 and row[0]["user_id"] == 7
    assert {r["seq"]: r["error_code"] for r in outcomes.collect()} == {1: "ok", 2: "not_found", 3: "invalid_user", 4: "id_is_null"}


def plans(spark):
    rows = [(f"p{i}", T0, stamp(i % 3), i % 2 if i % 5 else None, *[f"{f}{i}" for f in T.FIELDS], "active" if i % 4 else "archived") for i in range(20)]
    return spark.createDataFrame(rows, SNAP), rows


def test_lists(spark):
    df, rows = plans(spark)
    page = T.list_itineraries(df, limit=4, offset=1).collect()
    want = sorted((r for r in rows if r[-1] == "active"), key=lambda r: (-r[2].timestamp(), r[0]))
    assert [r["id"] for r in page] == [r[0] for r in want[1:5]] and {r["total_count"] for r in page} == {len(want)}
    mine = T.list_user_itineraries(df, 1, status=None, limit=50)
    assert {r["id"] for r in mine.collect()} == {r[0] for r in rows if r[3] == 1}
    assert T.list_user_itineraries(df, None).count() == 0 and T.list_itineraries(df, status=None, limit=99).count() == 20
    assert T.list_itineraries(df, user=0, status=None, limit=99).count() == len([r for r in rows if r[3] == 0])
    assert mine.columns == ["id", "title", "destinations", "dates", "status", "created_at", "updated_at", "total_count"]


def test_reads(spark):
    df, _ = plans(spark)
    asked = [(1, "p1", 1), (2, "p1", 0), (3, "p1", None), (4, "p5", None), (5, "none", 1), (6, None, 1), (7, "p0", 3)]
    reqs = spark.createDataFrame(asked, "request_id int, id string, user_id int")
    got = {r["request_id"]: (r["access_status"], r["id"]) for r in T.read_itineraries(reqs, df).collect()}
    assert got == {1: ("ok", "p1"), 2: ("forbidden", None), 3: ("forbidden", None), 4: ("ok", "p5"), 5: ("not_found", None), 6: ("not_found", None), 7: ("ok", "p0")}
    open_ = {r["request_id"]: r["access_status"] for r in T.read_itineraries(reqs, df, "as_coded").collect()}
    assert open_[3] == "ok" and open_[2] == "forbidden"
    with pytest.raises(ValueError):
        T.read_itineraries(reqs, df, "x")
