"""Tables in buckets, merged logs, places along a curve, and pages far down."""

import os
import random

import pytest
from pyspark.sql import functions as F

from placeweave.functions import geo, trigram
from placeweave.operators import areas as A
from placeweave.operators import classify, pages
from placeweave.operators.search import search_locations
from placeweave.operators import search_many
from placeweave.operators.search_many import search_locations_many, similar_pairs
from placeweave.sources import buckets, logs, manifests, readers, writers


def files_of(base):
    return {os.path.join(d, f) for d, _, names in os.walk(base) for f in names if f.endswith(".parquet")}


def test_a_change_rewrites_only_its_buckets(spark, tmp_path):
    base = str(tmp_path / "t")
    df = spark.range(100_000).select("id", (F.col("id") * 2).alias("v"), F.lit("x").alias("w"))
    assert buckets.create_table(df, base, "id", 16) == 0
    before = files_of(base)
    change = spark.createDataFrame([(77, 5)], "id long, v long")
    assert buckets.upsert_table(base, change) == 1
    added = files_of(base) - before
    assert len(added) == 1 and before <= files_of(base)
    now = {r["id"]: tuple(r) for r in buckets.read_table(spark, base).filter("id IN (77, 78)").collect()}
    assert now == {77: (77, 5, "x"), 78: (78, 156, "x")}
    assert buckets.read_table(spark, base, 0).filter("id = 77").first()["v"] == 154
    assert buckets.read_table(spark, base).count() == 100_000 and buckets.table_versions(spark, base) == [0, 1]
    assert buckets.delete_from_table(base, spark.createDataFrame([(77,), (5,), (-1,)], "id long")) == 2
    assert buckets.read_table(spark, base).count() == 99_998 and buckets.read_table(spark, base, 1).count() == 100_000
    assert buckets.upsert_table(base, change.limit(0)) == 3 and buckets.read_table(spark, base).count() == 99_998


def test_upserts_equal_a_plain_version(spark, tmp_path):
    rng, base, want = random.Random(6), str(tmp_path / "t"), {}
    schema = "k string, n int, v string"
    buckets.create_table(spark.createDataFrame([], schema), base, ["k", "n"], 5)
    for _ in range(4):
        rows = {(rng.choice("abcdeé"), rng.randrange(4)): rng.choice(["1", "2", None]) for _ in range(9)}
        want |= rows
        buckets.upsert_table(base, spark.createDataFrame([(*k, v) for k, v in rows.items()], schema))
        assert {(r["k"], r["n"]): r["v"] for r in buckets.read_table(spark, base).collect()} == want


def test_two_writers_cannot_publish_one_version(spark, tmp_path):
    path = str(tmp_path / "m")
    manifests.publish(spark, path, 0, {"a": 1})
    with pytest.raises(manifests.TakenVersion):
        manifests.publish(spark, path, 0, {"a": 2})
    assert manifests.load(spark, path) == {"a": 1} and manifests.versions(spark, path) == [0]
    assert manifests.load(spark, str(tmp_path / "none")) is None


def test_a_stream_of_changes_and_a_repeated_batch(spark, tmp_path):
    base, feed = str(tmp_path / "t"), str(tmp_path / "feed")
    schema = "id long, v string, at int, extra string"
    buckets.create_table(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), base, "id", 4)

    def send(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(feed)
        stream = spark.readStream.schema(schema).json(feed)
        buckets.upsert_stream(stream, base, "feed", [F.col("at").desc()], str(tmp_path / "c")).awaitTermination()
        return {r["id"]: r["v"] for r in buckets.read_table(spark, base).collect()}

    assert send([(2, "x", 1, "e"), (2, "y", 2, "e"), (3, "z", 1, None), (None, "n", 1, None)]) == {1: "a", 2: "y", 3: "z"}
    versions = buckets.table_versions(spark, base)
    late = spark.createDataFrame([(1, "late", 9, None)], schema)
    assert buckets.apply_batch(late, 0, base, "feed", [F.col("at").desc()]) == versions[-1]
    assert buckets.table_versions(spark, base) == versions
    assert send([(1, "w", 1, None)]) == {1: "w", 2: "y", 3: "z"}
    assert buckets.apply_batch(late, 0, base, "another", [F.col("at").desc()]) == versions[-1] + 2


def last(spark, log):
    return {r["label"]: r["buckets"] for r in classify.last_assignments(readers.read_assignments(spark, log)).collect()}


def append(spark, log, rows):
    writers.append_assignments(spark.createDataFrame(rows, "label string, buckets array<string>").coalesce(1), log)


def test_logs_merge_while_others_read_and_append(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    assert logs.merge_log(spark, log) is None
    append(spark, log, [("a", ["x"]), ("b", ["y"]), ("a", ["z"])])
    append(spark, log, [("b", []), ("c", ["q"])])
    before = last(spark, log)
    open_reader = readers.read_assignments(spark, log)
    # An entry that comes while the merge is at work is newer than what it merges.
    publish = manifests.publish
    monkeypatch.setattr(manifests, "publish", lambda *a: (append(spark, log, [("c", ["late"])]), publish(*a)))
    assert logs.merge_log(spark, log) == 0
    monkeypatch.undo()
    assert last(spark, log) == before | {"c": ["late"]}
    assert {r["label"]: r["buckets"] for r in classify.last_assignments(open_reader).collect()} == before
    append(spark, log, [("a", ["new"])])
    assert logs.merge_log(spark, log) == 1 and logs.merge_log(spark, log) is None
    want = before | {"c": ["late"], "a": ["new"]}
    small = len([f for f in os.listdir(log) if f.endswith(".json")])
    assert last(spark, log) == want and logs.purge_log(spark, log) == 2
    assert len([f for f in os.listdir(log) if f.endswith(".json")]) == small - 2 and last(spark, log) == want
    append(spark, log, [("d", ["e"])])
    assert logs.merge_log(spark, log) == 2 and last(spark, log) == want | {"d": ["e"]}
    assert readers.read_assignments(spark, log).count() == 4


def test_places_along_a_curve_are_skipped(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.uniform(-170, 170), rng.uniform(-80, 80)) for i in range(60_000)] + [(-1, None, None)]
    df = spark.createDataFrame(rows, "id long, longitude double, latitude double")
    path = str(tmp_path / "places")
    writers.write_places_by_curve(df, path, row_group=16 << 10)
    back = spark.read.parquet(path)
    assert back.count() == 60_001
    box = (100.0, 1.0, 110.0, 7.0)
    near = A.in_box(back, box)
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(longitude,100.0)" in plan and "LessThanOrEqual(latitude,7.0)" in plan

    def scanned(query):
        query.collect()
        found = query._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(found.apply(i).metrics().apply("numOutputRows").value() for i in range(found.size()))

    assert {r["id"] for r in near.collect()} == {i for i, x, y in rows if x is not None and 100 <= x <= 110 and 1 <= y <= 7}
    assert scanned(A.in_box(spark.read.parquet(path), box)) < 10_000
    assert scanned(A.in_box(spark.read.parquet(path), (-10.0, -80.0, 170.0, 80.0))) > 25_000
    edges = spark.createDataFrame([("a", 1.0, 2.0, 3.0, -1.0), ("a", 3.0, -1.0, 1.0, 2.0)], "area_id string, x1 double, y1 double, x2 double, y2 double")
    assert A.bounding_box(edges) == (1.0, -1.0, 3.0, 2.0) and A.bounding_box(edges.limit(0)) is None


def test_near_places_are_near_on_the_curve(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.001, 0.001), (179.0, 89.0), (-180.0, -90.0), (180.0, 90.0), (None, 1.0)], "x double, y double")
    got = [r[0] for r in df.select(geo.morton("x", "y")).collect()]
    assert abs(got[0] - got[1]) < 64 and got[3] == 0 and got[4] == 2**32 - 1 and got[5] is None and got[2] > got[0]


def test_deep_pages_equal_a_sort(spark):
    df = spark.range(30_000).select("id", (F.col("id") * 7919 % 13).alias("n"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("r"))
    order = [F.col("n").isNull(), -F.col("n"), F.col("r").isNull(), -F.col("r"), F.col("id")]
    rows = sorted(df.collect(), key=lambda r: (-r["n"], r["r"] is None, -(r["r"] or 0), r["id"]))
    for offset, limit in ((0, 5), (12_345, 20), (29_990, 50), (30_000, 5), (17, 0), (9_999, 2_000)):
        page, total = pages.deep_page(df, order, "id", offset, limit, rows=300)
        assert total == 30_000
        assert [r["id"] for r in page.collect()] == [r["id"] for r in rows[offset:offset + limit]]
    hot = spark.range(5_000).select("id", F.lit(1).alias("n"))
    page, _ = pages.deep_page(hot, [F.col("n"), F.col("id")], "id", 4_000, 3, rows=100)
    assert [r["id"] for r in page.collect()] == [4_000, 4_001, 4_002]
    assert pages.deep_page(hot.limit(0), [F.col("n"), F.col("id")], "id", 0, 3)[0].count() == 0


def test_a_deep_page_sorts_one_range_only(spark):
    df = spark.range(1_200_000).select("id", (F.xxhash64("id") % 1000).alias("n"))
    page, total = pages.deep_page(df, [F.col("n"), F.col("id")], "id", 1_000_000, 10)
    plan = page._jdf.queryExecution().optimizedPlan()
    assert total == 1_200_000 and page.count() == 10
    skip = int(plan.toString().split("Offset ")[1].split("\n")[0])
    assert skip < pages.ROWS


def test_many_searches_equal_single_ones(spark):
    rng = random.Random(9)
    words = ["Kuala", "Lumpur", "Johor", "Bahru", "Pulau", "Pinang", "town", "Town", "bay", "x"]
    rows = [(f"a{i}", " ".join(rng.choices(words, k=rng.randint(1, 4))), rng.choice(["state", "country"]), rng.choice(["SG", "MY", "R1"]), None, 4)
            for i in range(300)] + [("n", None, "state", "SG", None, 4), ("e", "", "state", "SG", None, 4)]
    areas = spark.createDataFrame(rows, "id string, name string, kind string, country_iso2 string, parent_id string, admin_level int").repartition(3)
    asked = ["kuala lumpur", "Kuala", "pulau pinag", "zzz", "t", "", "johor bahru town", "--", "Pu", "kuala"]
    queries = spark.createDataFrame([(q,) for q in [*asked, None, "Kuala"]], "query string")
    got = {}
    for r in search_locations_many(areas, queries, limit=4).orderBy("rank").collect():
        got.setdefault(r["query"], []).append((r["id"], r["label"]))
    for q in asked:
        single = [(r["id"], r["label"]) for r in search_locations(areas, q, limit=4).collect()]
        assert got.get(q, []) == single, q


def test_names_that_all_resemble_a_query_are_not_all_met(spark):
    rng = random.Random(4)
    rows = [(i, f"Customer Town {rng.randrange(10 ** 6):07d}") for i in range(1500)]
    names = spark.createDataFrame(rows, "id int, name string").withColumn("grams", trigram.trigrams("name"))
    texts = {f"Customer#{name[14:14 + rng.randint(1, 7)]}" for _, name in rows[:150]} | {"Customer#O1", "town", "custom"}
    queries = spark.createDataFrame([(q,) for q in texts], "query string").withColumn("grams", trigram.trigrams("query"))
    every = names.crossJoin(queries.select("query", F.col("grams").alias("q"))).select("id", "query", trigram.similarity(F.col("grams"), F.col("q")).alias("sim"))
    want = {}
    for r in every.filter("sim >= 0.3").collect():
        want.setdefault(r["query"], {})[r["id"]] = r["sim"]
    met = similar_pairs(names, queries, "id", best=5).collect()
    got = {}
    for r in met:
        got.setdefault(r["query"], {})[r["id"]] = r["sim"]
    for q, found in want.items():
        last = sorted(found.values(), reverse=True)[:5][-1]
        least = {i: s for i, s in found.items() if s >= last}
        assert least.items() <= got[q].items() <= found.items()
    assert got.keys() == want.keys()
    # Nearly all pairs resemble each other; few of them are met.
    assert sum(map(len, want.values())) > 150_000 and len(met) < 30_000
    whole = similar_pairs(names, queries.filter("length(query) > 13"), "id").collect()
    assert {(r["query"], r["id"], r["sim"]) for r in whole} == {(q, i, s) for q, f in want.items() if len(q) > 13 for i, s in f.items()}


def test_names_that_share_two_rare_trigrams_only_are_not_met(spark, monkeypatch):
    rng = random.Random(6)
    names = spark.createDataFrame(
        [(i, f"Customer Town {rng.randrange(10 ** 6):09d}") for i in range(3000)], "id int, name string").withColumn("grams", trigram.trigrams("name"))
    queries = spark.createDataFrame(
        [(f"Customer#{rng.randrange(10 ** 6):09d}"[:rng.randint(15, 18)],) for _ in range(150)], "query string").distinct().withColumn("grams", trigram.trigrams("query"))
    counted, measured = [], search_many._measured

    def seen(pairs, *rest):
        counted.append(pairs.count())
        return measured(pairs, *rest)

    monkeypatch.setattr(search_many, "_measured", seen)
    got = similar_pairs(names, queries, "id", best=5)
    best = names.crossJoin(queries.select("query", F.col("grams").alias("q"))).select("id", "query", trigram.similarity(F.col("grams"), F.col("q")).alias("sim"))
    want = {}
    for r in best.filter("sim >= 0.3").collect():
        want.setdefault(r["query"], []).append((r["sim"], r["id"]))
    found = {}
    for r in got.collect():
        found.setdefault(r["query"], set()).add((r["sim"], r["id"]))
    for q, all_ in want.items():
        last = sorted(all_, reverse=True)[:5][-1][0]
        assert {p for p in all_ if p[0] >= last} <= found[q] <= set(all_)
    assert counted[-1] < 3 * sum(map(len, found.values()))


def test_the_best_of_many_names_that_begin_with_a_query(spark):
    rows = [(i, f"Town {i % 7}{'x' * (i % 11)} {i}") for i in range(400)] + [(400, "To"), (401, "To!"), (402, "to wn"), (403, "??"), (404, "?")]
    names = spark.createDataFrame(rows, "id int, name string").withColumn("grams", trigram.trigrams("name"))
    queries = spark.createDataFrame([("to",), ("Town 1",), ("?",), ("zz",), ("",)], "query string")
    got = {}
    for r in search_many.prefix_pairs(names, queries, "id", best=4).collect():
        got.setdefault(r["query"], set()).add(r["id"])
    for q in ("to", "Town 1", "?"):
        every = names.filter(F.startswith(F.lower("name"), F.lit(q.lower()))).select(
            "id", trigram.similarity(F.col("grams"), trigram.trigrams(F.lit(q))).alias("sim"), F.length("name").alias("n")).collect()
        assert got[q] == {r["id"] for r in sorted(every, key=lambda r: (-r["sim"], r["n"], r["id"]))[:4]}, q
    assert got.keys() == {"to", "Town 1", "?"}
