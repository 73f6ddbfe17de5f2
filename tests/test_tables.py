import json
import os
import time

import pytest
from pyspark.sql import functions as F

from placeweave import schemas
from placeweave.operators import classify, clean, skew, tables
from placeweave.sources import readers, writers


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    feed = spark.createDataFrame([("b", 3, "z", 1), ("b", 4, "z", 2), ("c", 5, None, 1), (None, 6, "n", 1)], "k string, v int, w string, at int")
    changes, rejects = tables.latest_changes(feed, "k", [F.col("at").desc()])
    assert [r["v"] for r in rejects.collect()] == [6]
    changes = changes.drop("at")
    new = tables.upsert(old, changes, "k")
    want = {("a", 1, "x"), ("b", 4, "z"), ("c", 5, None)}
    assert {tuple(r) for r in new.collect()} == want
    assert {tuple(r) for r in tables.upsert(new, changes, "k").collect()} == want
    partly = tables.upsert(old, changes, "k", update_columns=["v"])
    assert {tuple(r) for r in partly.collect()} == {("a", 1, "x"), ("b", 4, "y"), ("c", 5, None)}


def test_reloading_areas_keeps_ids_and_clears_parents(spark):
    schema = "id string, name string, country_iso2 string, kind string, admin_level int, parent_id string"
    old = spark.createDataFrame([("1", "A", "SG", "state", 4, "p"), ("2", "B", "SG", "state", 4, "p")], schema)
    new = spark.createDataFrame([("9", "A", "SG", "state", 5, None), ("8", "A", "SG", "country", 2, None)], schema)
    assert {tuple(r) for r in tables.upsert_areas(old, new).collect()} == {
        ("1", "A", "SG", "state", 5, None), ("2", "B", "SG", "state", 4, "p"), ("8", "A", "SG", "country", 2, None)}


def test_pairs_and_deletes(spark, monkeypatch):
    pairs = spark.createDataFrame([("a", "r"), ("b", "r")], "category string, role string")
    want = spark.createDataFrame([("b", "r"), ("c", "r")], "category string, role string")
    assert tables.add_pairs(pairs, want).count() == 3
    assert [tuple(r) for r in tables.sync_delete(pairs, want).collect()] == [("b", "r")]
    assert [tuple(r) for r in tables.stale_pairs(pairs, want).collect()] == [("a", "r")]
    kids = spark.createDataFrame([(1, 10), (2, None), (3, 11)], "id int, user_id int")
    gone = spark.createDataFrame([(10,), (None,)], "user_id int")
    assert sorted(r["id"] for r in tables.cascade_delete(kids, gone, "user_id", "id").collect()) == [2, 3]
    parents = spark.createDataFrame([(11,)], "id int")
    assert [r["id"] for r in tables.orphans(kids, parents, "user_id").collect()] == [1]
    edges = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "area_id string, n int")
    newer = spark.createDataFrame([("a", 9), ("c", 8)], "area_id string, n int")
    for rows in (skew.BROADCAST_ROWS, -1):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", rows)
        got = tables.replace_groups(edges, newer, "area_id", "n").collect()
        assert {tuple(r) for r in got} == {("a", 9), ("c", 8), ("b", 3), (None, 4)}
    found = spark.createDataFrame([(2, 99)], "id int, user_id int")
    assert {tuple(r) for r in tables.fill_from(kids, found, "id", "user_id").collect()} == {(1, 10), (2, 99), (3, 11)}


def test_snapshots(spark, tmp_path):
    base = str(tmp_path / "plans")
    assert writers.snapshot_versions(spark, base) == []
    assert writers.write_snapshot(spark.range(3), base) == 0
    grown = readers.read_table(spark, f"{base}/v=0").unionByName(spark.range(3, 5))
    assert writers.write_snapshot(grown, base) == 1
    os.makedirs(f"{base}/v=2")  # a write that did not finish
    assert writers.read_snapshot(spark, base).count() == 5 and writers.read_snapshot(spark, base, 0).count() == 3
    assert writers.write_snapshot(spark.range(1), base) == 2


def test_csv(spark, tmp_path):
    tree = tmp_path / "map" / "deep"
    tree.mkdir(parents=True)
    text = 'cid,title,link,categories,review_count,review_rating\nz,"A ""quoted""\nname",l1,"[""x"", ""y""]",5,bad\n'
    (tmp_path / "map" / "one.csv").write_text(text)
    (tree / "two.csv").write_text(text.replace("l1", "l2"))
    (tree / "skip.txt").write_text("no")
    flat = readers.read_csv(spark, str(tmp_path / "map" / "one.csv"))
    assert [f.name for f in flat.schema] == [f.name for f in schemas.RAW_LISTING]
    assert [(r["title"], r["categories"], r["review_count"], r["review_rating"], r["phone"]) for r in flat.collect()] == [
        ('A "quoted"\nname', '["x", "y"]', 5, None, None)]
    assert {r["link"] for r in readers.read_csv(spark, str(tmp_path / "map"), recursive=True).collect()} == {"l1", "l2"}
    assert [r["link"] for r in readers.read_csv(spark, str(tmp_path / "map")).collect()] == ["l1"]
    (tmp_path / "map" / "three.csv").write_text("link,title\nl3,t\n")
    with pytest.raises(Exception, match="header"):
        readers.read_csv(spark, str(tmp_path / "map")).collect()
    every = {(r["link"], r["title"], r["cid"] if "cid" in r else None) for r in readers.read_csv(spark, str(tmp_path / "map"), recursive=True).collect()}
    assert {(link, title) for link, title, _ in every} == {("l1", 'A "quoted"\nname'), ("l2", 'A "quoted"\nname'), ("l3", "t")}
    (tmp_path / "order.csv").write_text("link,title,complete_address,review_count,review_rating,categories\n" + "".join(
        f'{link},tea,"{{""country"":""SG""}}",99,4.5,cafe\n' for link in ("z", "a", "m")))
    placed = readers.read_csv(spark, str(tmp_path / "order.csv"), positions=True)
    assert [r["link"] for r in placed.orderBy("seq").collect()] == ["z", "a", "m"]
    assert [r["link"] for r in clean.clean_listings(placed).collect()] == ["z"] and "seq" not in clean.clean_listings(placed).columns
    (tmp_path / "guide_1.csv").write_text("ID,Name,PhoneNumber,PriceRange,Images\n1,N,61234567,$$,a\n")
    guide = clean.clean_guide(readers.read_guide(spark, str(tmp_path / "guide*.csv")))
    assert guide.first().asDict() == {"name": "N", "phone": "+6561234567", "price": "$$", "images": ["a"]}
    out = str(tmp_path / "out")
    assert writers.write_csv(spark.createDataFrame([("a", ["x"])], "k string, v array<string>"), out)
    assert spark.read.csv(out, header=True, escape='"').first()["v"] == '["x"]'
    assert not writers.write_csv(spark.createDataFrame([], "k string"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_token_files(spark, tmp_path):
    (tmp_path / "attractions").mkdir()
    (tmp_path / "meal.txt").write_text(" Cafe & Bar \n\ncafe\ncafe\n")
    (tmp_path / "attractions" / "nature.txt").write_text("Park\n")
    (tmp_path / "accomodation.txt").write_text("Hotel\n")
    lists = readers.read_token_lists(spark, str(tmp_path))
    assert {tuple(r) for r in lists.collect()} == {("meal", "Cafe & Bar"), ("meal", "cafe"), ("attractions/nature", "Park"), ("accomodation", "Hotel")}
    assert {tuple(r) for r in classify.build_role_map(lists).collect()} == {
        ("cafe and bar", "meal"), ("cafe", "meal"), ("park", "attraction"), ("hotel", "accommodation")}
    assert [tuple(r) for r in classify.build_theme_map(lists).collect()] == [("nature", "park")]
    assert {r["token"] for r in readers.read_tokens(spark, str(tmp_path / "meal.txt")).collect()} == {"Cafe & Bar", "cafe"}
    out = str(tmp_path / "sorted")
    writers.write_tokens(spark.createDataFrame([("b",), ("A",), ("a",), ("b",)], "token string"), out, ignore_case=True)
    parts = sorted(f for f in os.listdir(out) if f.startswith("part"))
    assert "".join(open(os.path.join(out, f)).read() for f in parts).split() == ["A", "a", "b"]


def test_groups_are_written_in_order(spark, tmp_path):
    rows = [("g", "b"), ("g", "A"), ("g", "a"), ("g", "b"), ("h", "x")]
    df = spark.createDataFrame(rows, "theme string, label string")
    writers.write_groups(df, str(tmp_path / "t"), "theme", "label")
    writers.write_index(df.distinct().withColumn("slug", F.lower("label")), str(tmp_path / "j"), "theme", "label")
    folder = tmp_path / "t" / "theme=g"
    assert "".join((folder / f).read_text() for f in sorted(os.listdir(folder)) if f.startswith("part")).split() == ["A", "a", "b"]
    read = spark.read.json(str(tmp_path / "j"))
    assert {tuple(r) for r in read.select("theme", "label", "slug").collect()} == {("g", "b", "b"), ("g", "A", "a"), ("g", "a", "a"), ("h", "x", "x")}


def test_log_and_batches(spark, tmp_path):
    log = str(tmp_path / "log")
    first = spark.createDataFrame([("a", ["meal"])], "label string, buckets array<string>").coalesce(1)
    writers.append_assignments(first, log)
    time.sleep(0.05)
    writers.append_assignments(spark.createDataFrame([("b", []), ("a", ["exclude"])], "label string, buckets array<string>").coalesce(1), log)
    log_rows = readers.read_assignments(spark, log)
    assert log_rows.count() == 3
    assert {r["label"]: r["buckets"] for r in classify.last_assignments(log_rows).collect()} == {"a": ["exclude"], "b": []}
    lines = '{"label":"x","buckets":["meal"]}\nnot json\n{"label":"x"}\n{"buckets":["meal"]}\n{"label":"y","buckets":["exclude"]}\n'
    (tmp_path / "one.jsonl").write_text(lines)
    read = readers.read_assignments(spark, str(tmp_path / "one.jsonl"))
    assert {r["label"]: r["buckets"] for r in classify.last_assignments(read).collect()} == {"x": [], "y": ["exclude"]}
    batches = classify.distinct_batches(spark.range(25).select(F.concat(F.lit("line "), "id").alias("line")))
    writers.write_batches(batches, str(tmp_path / "rows"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "rows")).collect()} == {tuple(r) for r in batches.collect()}
    writers.export_batches(batches, str(tmp_path / "batches"))
    again = spark.read.text(str(tmp_path / "batches"))
    assert again.count() == 25 and {r["n"] for r in again.groupBy("batch_no").agg(F.count("*").alias("n")).collect()} == {10, 5}


def test_boundaries(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "A", "country_iso2": "SG", "kind": "state", "admin_level": 4},
                                                      "geometry": {"type": "Polygon", "coordinates": square}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc, indent=1))
    from placeweave.operators.areas import load_areas
    areas, edges, rejects = load_areas(readers.read_boundaries(spark, str(tmp_path / "a.geojson")))
    assert areas.first()["name"] == "A" and edges.count() == 4 and rejects.count() == 0


def test_hot_keys(spark, monkeypatch):
    """A key with a third of all rows: same rows with broadcast and with salts."""
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"))
    small = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi"):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 10**6)
        a = sorted(map(tuple, skew.lookup_join(big, small, "k", "id", how).collect()), key=repr)
        monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)
        b = sorted(map(tuple, skew.lookup_join(big, small, "k", "id", how).collect()), key=repr)
        assert a == b
    sized = skew.with_totals(big, "k", "id", {"n": F.count(F.lit(1))}, {"n": F.sum("n")})
    want = {r["k"]: r["n"] for r in big.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sized.collect()
    assert len(rows) == 3000 and all(r["n"] == want[r["k"]] for r in rows)
    for k in (3, 1200):
        top = skew.top_per_group(big, "k", [F.col("id").desc()], k, "id", out="rn")
        assert {(r["k"], r["rn"]): r["id"] for r in top.filter("k = 0").collect()} == {
            (0, i + 1): v for i, v in enumerate(sorted((x for x in range(3000) if x % 3 == 0 or x % 500 == 0), reverse=True)[:k])}


def test_copies_of_a_lookup_do_not_grow_with_its_pairs(spark, monkeypatch):
    """300 rows and 50 lookup rows a key: no copies; a hot key is cut, and copied as often."""
    big = spark.range(30_000).select("id", (F.col("id") % 100).alias("k"))
    small = spark.range(5_000).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    _, copies = skew.salted_sides(big, small, ["k"], "id")
    assert copies.count() == 5_000
    monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)
    met = skew.lookup_join(big, small, "k", "id")
    assert met.columns == ["k", "id", "v"] and met.count() == 30_000 * 50
    assert "BroadcastHashJoin" not in met.select("v")._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
    monkeypatch.setattr(skew, "KEY_ROWS", 100)
    hot = big.unionByName(spark.range(30_000, 40_000).select("id", F.lit(7).alias("k")))
    salted, copies = skew.salted_sides(hot, small, ["k"], "id")
    assert copies.count() == 99 * 50 * 3 + 50 * 103
    assert salted.groupBy("k", "__salt").count().agg(F.max("count")).first()[0] < 200
    assert skew.lookup_join(hot, small, "k", "id").count() == 40_000 * 50


def test_checkpoint_goes_to_the_named_folder(spark):
    cut = skew.cut_lineage(spark.range(5).withColumn("x", F.col("id") + 1))
    assert cut.count() == 5 and "Scan ExistingRDD" in cut._jdf.queryExecution().executedPlan().toString()
    assert spark.sparkContext.getCheckpointDir() is not None


def test_broadcasts_are_counted_and_measured(spark, monkeypatch):
    narrow = spark.range(1000)
    assert skew.fits_broadcast(narrow, 1000) and not skew.fits_broadcast(narrow, 999)
    wide = narrow.withColumn("body", F.repeat(F.lit("x"), 1000))
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 500_000)
    assert skew.fits_broadcast(narrow, 1000) and not skew.fits_broadcast(wide, 1000)
    joined = skew.lookup_join(spark.range(5), wide, "id", "id")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().optimizedPlan().toString() and joined.count() == 5
    # The count stops one row after the bound: a row behind it would raise.
    trap = spark.range(0, 100, 1, 1).select(F.when(F.col("id") > 50, F.raise_error(F.lit("read too far"))).otherwise(F.col("id")).alias("id"))
    assert not skew.fits_broadcast(trap, 20)


def test_a_hot_key_reaches_the_tasks(spark):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(4000).withColumn("k", F.lit(1)).withColumn("s", skew.salt("id", skew.salts_for(spark)))
    dealt = rows.repartition(tasks, "k", "s").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == tasks and max(r["count"] for r in dealt) < 3 * 4000 / tasks


def test_numbering_rejects_bad_digits(spark):
    with pytest.raises(ValueError):
        classify.numbered(spark.range(1), "id", 10, 0)
