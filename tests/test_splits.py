"""Large single files, read by several tasks, against Spark's readers of whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from placeweave import schemas
from placeweave.operators import areas as A
from placeweave.sources import readers, splits

NAMES = ["link", "title", "descriptions", "review_count"]


@pytest.fixture
def small_ranges(spark):
    """Ranges of 4 KB, so that a file of some hundred has many."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def quoted(value):
    return "" if value is None else '"' + value.replace('"', '""') + '"'


def listings(seed, n):
    rng = random.Random(seed)
    bits = ["plain", 'with "quotes"', "a,comma", "line\nbreak", "two\n\n\nbreaks", '"', "", "é ü 字", "x" * 300, "\\", "tab\t", '","', '"\n"']
    return [(f"l{i}", "".join(rng.choices(bits, k=3)), rng.choice([None, *bits]), rng.choice([None, "7", "bad"])) for i in range(n)]


def write(path, header, rows, end="\n"):
    path.write_text(end.join([",".join(header), *[",".join(map(quoted, r)) for r in rows]]) + end, newline="")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path, small_ranges, end):
    path = tmp_path / "big.csv"
    write(path, NAMES, listings(1, 400), end)
    lines = splits.pieces(spark, str(path), "\n")
    assert lines.select("block").distinct().count() > 8
    got = readers.read_csv(spark, str(path), split=True, positions=True)
    want = readers.read_csv(spark, str(path))
    assert sorted(map(tuple, got.drop("seq").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert [r["link"] for r in got.orderBy("seq").collect()] == [f"l{i}" for i in range(400)]


def test_a_row_over_many_ranges(spark, tmp_path, small_ranges):
    path = tmp_path / "long.csv"
    rows = [("a", "x", "line\n" * 5000, "1"), ("b", "y", '"' * 9001 + "\n", "2"), ("c", "z", None, "3")]
    write(path, NAMES, rows)
    got = {r["link"]: (r["title"], r["descriptions"], r["review_count"]) for r in readers.read_csv(spark, str(path), split=True).collect()}
    assert got == {"a": ("x", "line\n" * 5000, 1), "b": ("y", '"' * 9001 + "\n", 2), "c": ("z", None, 3)}


def test_trees_of_files_with_different_headers(spark, tmp_path, small_ranges):
    (tmp_path / "deep").mkdir()
    write(tmp_path / "one.csv", ["link", "title"], [(f"a{i}", "t\nt") for i in range(900)])
    write(tmp_path / "deep" / "two.csv", ["title", "extra", "link"], [("u", "e", f"b{i}") for i in range(700)])
    (tmp_path / "three.csv").write_text('"li""nk","title\nof",link\nx,y,c0\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("link,title\n")
    got = [(r["link"], r["title"], r["phone"]) for r in readers.read_csv(spark, str(tmp_path), recursive=True).collect()]
    want = [(f"a{i}", "t\nt", None) for i in range(900)] + [(f"b{i}", "u", None) for i in range(700)] + [("c0", None, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def feature(k, rng):
    ring = [[rng.uniform(0, 9), rng.uniform(0, 9)] for _ in range(rng.randrange(3, 60))]
    name = rng.choice(["plain", 'a "b"', "br{ace}", "}{", "back\\slash", "\\", 'end\\"', "[x]", "é"]) + str(k)
    return {"type": "Feature", "properties": {"name": name, "country_iso2": "SG", "kind": "state", "admin_level": 4, "more": {"deep": [{"x": "}"}]}},
            "geometry": {"type": "Polygon", "coordinates": [[*ring, ring[0]]]}}


@pytest.mark.parametrize("indent", [None, 1])
def test_one_boundary_file_is_read_by_many_tasks(spark, tmp_path, small_ranges, indent):
    rng = random.Random(3)
    features = [feature(k, rng) for k in range(120)]
    whole = {"type": "FeatureCollection", "name": "a { name", "crs": {"type": "name", "properties": {"name": "EPSG"}}, "features": features, "after": {"type": "x"}}
    path = tmp_path / "big.geojson"
    path.write_text(json.dumps(whole, indent=indent) + "\n" * (5000 if indent else 1))
    assert splits.pieces(spark, str(path), "}").select("block").distinct().count() > 8
    objects = splits.read_json_objects(spark, str(path))
    assert objects.agg(F.max(F.length("value"))).first()[0] < 12_000
    got = readers.read_boundaries(spark, str(path))
    assert got.columns == [f.name for f in schemas.FEATURE["properties"].dataType] + ["geometry"]
    read = sorted((r["name"], json.dumps(json.loads(r["geometry"]))) for r in got.collect())
    assert read == sorted((f["properties"]["name"], json.dumps(f["geometry"])) for f in features)
    assert A.load_areas(got)[0].count() == 120


def test_several_boundary_files(spark, tmp_path):
    rng = random.Random(4)
    for n in range(3):
        (tmp_path / f"{n}.geojson").write_text(json.dumps({"features": [feature(10 * n + k, rng) for k in range(n)], "type": "FeatureCollection"}))
    assert readers.read_boundaries(spark, str(tmp_path)).count() == 3
