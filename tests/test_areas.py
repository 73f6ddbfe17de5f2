import json
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from placeweave.functions import geo
from catalog import places
from placeweave.operators import areas as A
from placeweave.operators import cover

SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
HOLE = [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]


def features(spark, rows):
    return spark.createDataFrame(
        rows, "seq int, name string, country_iso2 string, kind string, admin_level int, parent_id string, geometry string")


def polygon(*rings, kind="Polygon"):
    return json.dumps({"type": kind, "coordinates": list(rings)})


def inside(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_load_areas(spark):
    rows = [
        (1, "a", "SG", "state", 4, None, polygon(SQUARE, HOLE)),
        (2, "b", "SG", "state", 4, None, json.dumps({"type": "Point", "coordinates": [1, 2]})),
        (3, "c", "SG", "state", 4, None, json.dumps({"type": "GeometryCollection", "geometries": []})),
        (4, "d", "SG", "state", 4, None, "junk"),
        (5, "a", "SG", "state", 5, None, polygon([[x, y, 7] for x, y in reversed(SQUARE)])),
        (6, "e", "SG", "country", 2, None, json.dumps({"type": "MultiPolygon", "coordinates": [[SQUARE], [[[9, 9], [10, 9], [10, 10], [9, 9]]]]})),
        (7, None, "SG", "country", 2, None, polygon(SQUARE)),
    ]
    areas, edges, rejects = A.load_areas(features(spark, rows))
    assert {(r["name"], r["admin_level"]) for r in areas.collect()} == {("a", 5), ("e", 2)}
    assert {r["name"] for r in rejects.collect()} == {"b", "c", "d", None}
    sizes = {r["name"]: r["area_size"] for r in A.area_sizes(edges).join(areas, F.col("area_id") == F.col("id")).collect()}
    assert sizes == {"a": 16.0, "e": 16.5}
    # Loaded edges carry the same facts, and the join does not need them to.
    assert {(r["area_size"], r["fineness"]) for r in edges.collect()} == {(16.0, 2), (16.5, 2)}
    point = spark.createDataFrame([(1, 9.5, 9.2)], "id int, longitude double, latitude double")
    for table in (edges, edges.drop("fineness", "area_size")):
        assert A.smallest_area(point, table).count() == 1


def test_points_on_borders_vertices_and_in_holes(spark):
    _, edges, _ = A.load_areas(features(spark, [(1, "a", "SG", "state", 4, None, polygon(SQUARE, HOLE))]))
    points = [(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 0.0, 2.0), (4, 4.0, 4.0), (5, 1.0, 2.0), (6, 3.0, 3.0), (7, 5.0, 2.0),
              (8, -0.1, 4.0), (9, 2.0, 4.0), (10, 2.0, 1.0), (11, None, 2.0), (12, 0.5, 3.0), (13, 0.5, 1.0)]
    df = spark.createDataFrame(points, "id int, longitude double, latitude double")
    got = {r["id"] for r in A.points_in_areas(df, edges).collect()}
    assert got == {1, 3, 4, 5, 6, 9, 10, 12, 13}


def test_star_polygons_equal_brute_force(spark):
    rng = random.Random(5)
    rings, rows = {}, []
    for k in range(4):
        cx, cy = 100 + 1.3 * k, 2 + 0.4 * k
        ring = []
        for i in range(180):
            r = rng.uniform(0.4, 2.0)
            ring.append([cx + r * math.cos(i * math.pi / 90), cy + r * math.sin(i * math.pi / 90)])
        rings[f"s{k}"] = ring + [ring[0]]
        rows.append((k, f"s{k}", "SG", "state", 4, None, polygon(rings[f"s{k}"])))
    areas, edges, _ = A.load_areas(features(spark, rows))
    points = [(i, rng.uniform(97, 107), rng.uniform(-1, 6)) for i in range(3000)]
    df = spark.createDataFrame(points, "id int, longitude double, latitude double")
    want = {(i, n) for i, x, y in points for n, ring in rings.items() if inside(ring, x, y)}
    names = areas.select(F.col("id").alias("area_id"), "name")
    for level in (None, 0, 4):
        sized = edges if level is None else edges.withColumn("fineness", F.lit(level))
        got = A.points_in_areas(df, sized).join(names, "area_id")
        assert {(r["id"], r["name"]) for r in got.collect()} == want


def test_smallest_and_most_specific_area(spark):
    rows = [(1, "big", "SG", "country", 2, None, polygon(SQUARE)), (2, "small", "SG", "state", 4, None, polygon(HOLE)),
            (3, "quarter", "SG", "district", 6, None, polygon([[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]))]
    areas, edges, _ = A.load_areas(features(spark, rows))
    names = {r["id"]: r["name"] for r in areas.collect()}
    pois = spark.createDataFrame([(1, 0.5, 0.5, None), (2, 2.5, 2.5, "kept"), (3, 1.5, 1.5, None), (4, 9.0, 9.0, "kept"), (5, None, None, None)],
                                 "id int, longitude double, latitude double, admin_area_id string")
    small = {r["id"]: names[r["area_id"]] for r in A.smallest_area(pois, edges).collect()}
    assert small == {1: "big", 2: "small", 3: "quarter"}
    linked = {r["id"]: names.get(r["admin_area_id"], r["admin_area_id"]) for r in A.link_poi_areas(pois, areas, edges).collect()}
    assert linked == {1: "big", 2: "small", 3: "small", 4: "kept", 5: None}


def test_parents(spark):
    far = [[20, 20], [21, 20], [21, 21], [20, 21], [20, 20]]
    corner = [[4, 4], [5, 4], [5, 5], [4, 5], [4, 4]]
    around = [[-1, -1], [9, -1], [9, 9], [-1, 9], [-1, -1]]
    rows = [(1, "land", "SG", "country", 2, None, polygon(SQUARE)), (2, "in", "SG", "state", 4, None, polygon(HOLE)),
            (3, "far", "SG", "state", 4, None, polygon(far)), (4, "corner", "SG", "state", 4, None, polygon(corner)),
            (5, "around", "SG", "state", 4, None, polygon(around)), (6, "foreign", "MY", "state", 4, None, polygon(HOLE)),
            (7, "set", "SG", "state", 4, "x", polygon(HOLE))]
    areas, edges, _ = A.load_areas(features(spark, rows))
    land = areas.filter("name = 'land'").first()["id"]
    got = {r["name"]: r["parent_id"] for r in A.link_area_parents(areas, edges).collect()}
    assert got == {"land": None, "in": land, "far": None, "corner": land, "around": land, "foreign": None, "set": "x"}


def test_distance(spark):
    cases = [((144.42486788888888, -37.95103341666667), (143.92649552777777, -37.65282113888889), 54972.271),
             ((0.0, 0.0), (1.0, 0.0), 111319.491), ((0.0, 0.0), (0.0, 1.0), 110574.389), ((103.8, 1.35), (103.8, 1.35), 0.0)]
    df = spark.createDataFrame([a for a, _, _ in cases] + [(None, 1.0)], "lon double, lat double")
    columns = [geo.distance("lon", "lat", *b).alias(f"d{i}") for i, (_, b, _) in enumerate(cases)]
    rows = df.select("lon", *columns, geo.distance("lon", "lat", None, 1).alias("none")).collect()
    for i, (_, _, want) in enumerate(cases):
        assert rows[i][f"d{i}"] == pytest.approx(want, abs=0.002)
    assert rows[-1]["d0"] is None and rows[0]["none"] is None


def test_long_rings_load_in_linear_time(spark):
    import time

    def load(n):
        ring = spark.range(1).select(F.sequence(F.lit(0), F.lit(n - 1)).alias("steps")).select(F.transform(
            "steps", lambda s: F.array(F.cos(s * 2 * F.pi() / n), F.sin(s * 2 * F.pi() / n))).alias("ring"))
        closed = ring.select(F.concat("ring", F.slice("ring", 1, 1)).alias("ring"))
        features = closed.select(
            F.lit("round").alias("name"), F.lit("R0").alias("country_iso2"), F.lit("state").alias("kind"), F.lit(4).alias("admin_level"),
            F.lit(None).cast("string").alias("parent_id"),
            F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates"))).alias("geometry")).cache()
        begun = time.perf_counter()
        _, edges, _ = A.load_areas(features)
        found = edges.agg(F.count("*").alias("n"), F.max("area_size").alias("size")).first()
        assert found["n"] == n and abs(found["size"] - 3.14159265) < 1e-4
        return time.perf_counter() - begun

    load(1000)
    times = [load(n) for n in (10_000, 20_000, 40_000)]
    # Twice the points may take twice as long, not four times; most is the start of the job.
    assert times[2] < 3 * times[0] + 2


def test_points_are_not_shuffled_while_edges_fit(spark):
    from catalog import places

    plan = A.link_poi_areas(places.plain_pois(spark, "/root/testdata/sf0.001").select("id", "admin_area_id", "longitude", "latitude"),
                            places.areas(spark, "/root/testdata/sf0.001"), places.edges(spark, "/root/testdata/sf0.001"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in text and "SortMergeJoin" not in text


def exact_side(a, b, p):
    """The sign of the turn by rational arithmetic on the decimals as written."""
    (ax, ay), (bx, by), (px, py) = [[Fraction(str(v)) for v in q] for q in (a, b, p)]
    turn = (bx - ax) * (py - ay) - (px - ax) * (by - ay)
    return (turn > 0) - (turn < 0)


def test_sides_are_those_of_the_decimals(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(600):
        a, b = [(round(rng.uniform(-180, 180), 3), round(rng.uniform(-80, 80), 3)) for _ in range(2)]
        t = rng.choice([0.1, 0.3, 0.5, 0.7, 1.1])
        at = [float(Fraction(str(u)) + (Fraction(str(v)) - Fraction(str(u))) * Fraction(str(t))) for u, v in zip(a, b)]
        nudge = rng.choice([0, 0, 1e-10, -1e-10, 1e-3])
        rows.append((*a, *b, round(at[0], 6), float(Fraction(str(round(at[1], 6))) + Fraction(str(nudge)))))
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double, px double, py double")
    got = [r[0] for r in df.select(F.expr(geo.side_sql(*df.columns))).collect()]
    want = [exact_side(r[:2], r[2:4], r[4:]) for r in rows]
    assert got == want and 50 < want.count(0)


def test_borders_on_grid_lines_and_through_corners(spark):
    """Areas whose vertices and edges lie on the lines of the grid, at every point of it, in cells of
    several sizes, against rational arithmetic."""
    shapes = {
        "square": [(0, 0), (2, 0), (2, 2), (0, 2)], "diamond": [(1, 0), (2, 1), (1, 2), (0, 1)],
        "notch": [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)], "spike": [(0, 0), (2, 1), (0, 1.5), (1, 0.75)],
        "steps": [(0, 0), (0.5, 0), (0.5, 0.5), (1, 0.5), (1, 1), (1.5, 1), (1.5, 2), (0, 2)],
    }
    rows, edges = [], []
    steps = [k / 8 for k in range(-4, 21)]
    for name, ring in shapes.items():
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            edges.append((name, float(x1), float(y1), float(x2), float(y2)))
    points = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in steps for y in steps)]
    rows = spark.createDataFrame(points, "id int, longitude double, latitude double")
    borders = spark.createDataFrame(edges, "area_id string, x1 double, y1 double, x2 double, y2 double")
    want = set()
    for i, x, y in points:
        for name, ring in shapes.items():
            sides = list(zip(ring, ring[1:] + ring[:1]))
            on = any(exact_side(a, b, (x, y)) == 0 and min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1]) for a, b in sides)
            if on or inside([*ring, ring[0]], x, y):
                want.add((i, name))
    for level in (None, -2, 1, 4):
        sized = A.with_area_facts(borders)
        sized = sized if level is None else sized.withColumn("fineness", F.lit(level))
        assert {tuple(r) for r in A.points_in_areas(rows, sized).collect()} == want, level
        first = {(r["id"], r["area_id"]) for r in A.with_first_area(rows, sized, "area_size").collect()}
        sizes = {r["area_id"]: r["area_size"] for r in A.area_sizes(borders).collect()}
        best = {i: min((sizes[n], n) for j, n in want if j == i)[1] for i in {j for j, _ in want}}
        assert first == {(i, best.get(i)) for i, _, _ in points}, level


def test_cells_inside_test_no_edges(spark):
    _, edges, _ = A.load_areas(features(spark, [(1, "a", "SG", "state", 4, None, polygon(SQUARE, HOLE))]))
    cells = cover.area_cells(edges.withColumn("fineness", F.lit(4)), []).collect()
    assert any(c["lines"] is None and c["run"] == 3 for c in cells)
    assert max(len(c["lines"]) for c in cells if c["lines"]) <= 4
    plan = A.points_in_areas(spark.createDataFrame([(1, 0.5, 0.5)], "id int, longitude double, latitude double"), edges)
    text = plan._jdf.queryExecution().executedPlan().toString()
    # Nothing is aggregated by point: the only aggregate lists the kinds of cells.
    assert "hashpartitioning(id" not in text and "keys=[id" not in text


def test_plain_cells_tell_by_sides_what_the_walk_tells(spark):
    """Cells with one edge, two that pass and two that meet, at points on a lattice, on the edges and
    anywhere: the bits of the cell against the walk along its edges."""
    rng = random.Random(3)
    shapes = {"diamond": [(1, 0), (2, 1), (1, 2), (0, 1)], "notch": [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)],
              "sliver": [(0, 0.01), (2, 1.02), (2, 1.03), (0, 0.04)], "spike": [(0.03, 0.07), (2, 1), (0.3, 1.55), (1, 0.75)]}
    edges = [(name, float(x1), float(y1), float(x2), float(y2)) for name, ring in shapes.items() for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])]
    borders = spark.createDataFrame(edges, "area_id string, x1 double, y1 double, x2 double, y2 double")
    lattice = [(x / 16, y / 16) for x in range(-2, 35) for y in range(-2, 35)]
    anywhere = [(rng.uniform(-0.1, 2.1), rng.uniform(-0.1, 2.1)) for _ in range(3000)]
    points = spark.createDataFrame(lattice + anywhere, "px double, py double")
    for level in (1, 3, 5):
        cells = cover.area_cells(borders.withColumn("fineness", F.lit(level)), []).filter("lines IS NOT NULL AND sides IS NOT NULL").cache()
        kinds = {r["n"] for r in cells.selectExpr("size(lines) AS n").distinct().collect()}
        assert kinds == {1, 2}
        kx, cy = cover.cell_of("px", "py", level, 0)
        met = points.selectExpr("*", f"{level} AS fineness", "0 AS run", f"{kx} AS kx", f"{cy} AS cy")
        walk = met.join(cells, cover.KEYS).selectExpr("px", "py", "area.area_id", f"{cover.holds('fineness', 'kx', 'cy', 'odd', 'lines', 'px', 'py')} AS held")
        bits = met.join(cover.plain(cells), cover.KEYS).selectExpr("px", "py", "area.area_id", f"({cover.holds_plain('px', 'py')}) AS held")
        want, got = [sorted(map(tuple, t.collect())) for t in (walk, bits)]
        assert got == want and len({r[3] for r in got}) == 2


def test_a_plain_border_takes_no_walk(spark):
    diamond = [(1.0003, 0.0), (2.0003, 1.0), (1.0003, 2.0), (0.0003, 1.0)]
    borders = spark.createDataFrame([("d", *a, *b) for a, b in zip(diamond, diamond[1:] + diamond[:1])], "area_id string, x1 double, y1 double, x2 double, y2 double")
    points = spark.range(200).selectExpr("id", "id % 20 / 10D AS longitude", "id div 20 / 5D AS latitude")
    held = A.points_in_areas(points, borders)
    assert "lambda" not in held._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"] for r in held.collect()} == {
        i for i in range(200) if abs(Fraction(i % 20, 10) - Fraction("1.0003")) + abs(Fraction(i // 20, 5) - 1) <= 1}


def test_dense_coasts_are_split(spark, monkeypatch):
    """A coast of 100,000 edges in a few cells against a neighbour's of 2,000: cells are split until
    none holds more than the bounded number of pairs, and nothing is missed."""
    def coast(name, n, lift):
        x = (F.col("id") / n) * 0.4
        y = F.lit(lift) + F.sin(F.col("id") * 0.7) * 0.0004
        nxt = ((F.col("id") + 1) / n) * 0.4, F.lit(lift) + F.sin((F.col("id") + 1) * 0.7) * 0.0004
        return spark.range(n).select(F.lit(name).alias("area_id"), F.lit("SG").alias("country_iso2"),
                                     x.alias("x1"), y.alias("y1"), nxt[0].alias("x2"), nxt[1].alias("y2"))

    left = coast("l", 100_000, 0.1).unionByName(coast("far", 500, 0.3))
    right = coast("r", 2_000, 0.1004).unionByName(coast("off", 500, 0.45))
    seen = []
    monkeypatch.setattr(A, "cut_lineage", lambda df: seen.append(df.cache()) or seen[-1])
    got = {tuple(r) for r in A.border_pairs(left, right).collect()}
    seen = [s for s in seen if "dense" in s.columns]
    assert got == {("l", "r")} and len(seen) > 1
    joined = [s.filter("NOT dense").agg(F.max(F.col("l") * F.col("r"))).first()[0] or 0 for s in seen]
    assert max(joined) <= A.PAIRS


def test_borders_in_parts_equal_whole_ones(spark):
    rng = random.Random(12)
    schema = "seq int, name string, country_iso2 string, kind string, admin_level int, parent_id string, ring_id int, part int, geometry string"

    def parts(seq, name, ring_id, ring, cuts):
        at = [0, *cuts, len(ring) - 1]
        return [(seq, name, "SG", "state", 4, None, ring_id, k, json.dumps({"type": "LineString", "coordinates": ring[i:j + 1]}))
                for k, (i, j) in enumerate(zip(at, at[1:]))]

    rings = {}
    for name in ("a", "b", "c"):
        ring = [[100 + rng.uniform(1, 2) * math.cos(i * math.pi / 50), 3 + rng.uniform(1, 2) * math.sin(i * math.pi / 50)] for i in range(100)]
        rings[name] = (ring + [ring[0]])[::rng.choice([1, -1])]
    hole = [[99.7, 2.7], [100.3, 2.7], [100.3, 3.3], [99.7, 3.3], [99.7, 2.7]]
    rows = parts(1, "a", 0, rings["a"], [10, 11, 60]) + parts(1, "b", 0, rings["b"], [50]) + parts(2, "c", 0, rings["c"], [])
    rows += parts(1, "b", 1, hole, [2, 3]) + parts(1, "c", 0, rings["a"], [7])
    rows += parts(1, "gap", 0, rings["a"], [20, 40])[::2] + parts(1, "open", 0, rings["a"][:-1], [20])
    rows += [*parts(1, "odd", 0, rings["a"], [30]), (1, "odd", "SG", "state", 4, None, 1, 0, polygon(SQUARE)), (1, None, "SG", "state", 4, None, 0, 0, polygon(SQUARE))]
    areas, edges, rejects = A.load_areas(spark.createDataFrame(rng.sample(rows, len(rows)), schema).repartition(3))
    whole, borders, _ = A.load_areas(features(spark, [(1, n, "SG", "state", 4, None, polygon(*([r, hole] if n == "b" else [r]))) for n, r in rings.items()]))
    assert sorted(map(tuple, areas.collect())) == sorted(map(tuple, whole.collect()))
    kept = ["area_id", "ring_id", "x1", "y1", "x2", "y2", "area_size", "fineness"]
    assert sorted(map(tuple, edges.select(kept).collect())) == sorted(map(tuple, borders.select(kept).collect()))
    assert sorted((str(r["name"]), r["reason"]) for r in rejects.collect()) == sorted(
        [("gap", "another part cannot be used: parts do not follow each other")] * 2 + [("open", "another part cannot be used: parts do not follow each other")] * 2
        + [("odd", "another part cannot be used: a part must be a LineString, got Polygon")] * 2
        + [("odd", "a part must be a LineString, got Polygon"), ("None", "a part must be a LineString, got Polygon")])


def test_a_ring_per_priority_holds_all_its_orders(spark, tmp_path):
    rows = [(k, k * 7 % 1000, ["1-URGENT", "2-HIGH"][k // 1000 % 2]) for k in range(0, 400_000, 1000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(str(tmp_path / "none" / "orders.parquet"))
    got = {r["name"]: r["edges"] for r in places.geojson_long_rings(spark, str(tmp_path)).collect()}
    assert got == {p: sum(r[2] == p for r in rows) for p in ("1-URGENT", "2-HIGH")}
    assert places.geojson_long_rings(spark, str(tmp_path / "none")).count() == 0
