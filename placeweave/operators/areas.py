"""Administrative areas as polygon edges, and the spatial joins on them.

An area's border is one row per edge. Points meet the cells of the areas' covers (`cover.py`) in an
equi-join: inside them no edge is tested, and a cell that the border passes holds the few edges that
matter there.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.functions.geo import segments_meet
from placeweave.functions.text import once
from placeweave.operators import skew
from placeweave.operators.cover import KEYS, area_cells, cell_of, columns_in_row, fineness, holds, holds_plain, plain, touched
from placeweave.operators.skew import cut_lineage, first_per_group, lookup_join, small_values

CELL = 0.5
# Cells may be broadcast up to so many times the usual number of rows: they are a few numbers.
NARROW = 5
# Kinds of cells (sizes and blocks) that points look up one after the other; more are looked up in
# rows of their own.
KINDS = 16

_RING = "array<array<double>>"


def _area_id():
    return F.sha2(F.concat_ws("|", "name", "country_iso2", "kind"), 256)


def _between(ring):
    """Edges from each point of a line to the next."""
    points = F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    count = F.greatest(F.size(ring) - 1, F.lit(0))
    return once(points, lambda xy: F.zip_with(F.slice(xy, 1, count), F.slice(xy, 2, count), lambda a, b: F.struct(
        a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))))


def _doubled(edges):
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + e["x1"] * e["y2"] - e["x2"] * e["y1"])


def _turned(edges):
    return F.transform(edges, lambda e: F.struct(
        e["x2"].alias("x1"), e["y2"].alias("y1"), e["x1"].alias("x2"), e["y1"].alias("y2")))


def _ring_edges(ring, outer):
    """Edges of a closed ring, counter-clockwise when outer and clockwise when a hole."""
    # Each step is computed once: a ring may have a hundred thousand points.
    return once(_between(ring), lambda edges: F.when((_doubled(edges) < 0) == outer, _turned(edges)).otherwise(edges))


def load_areas(features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boundary rows (name, country_iso2, kind, admin_level, parent_id, geometry as GeoJSON text)
    to areas, edges and rejects. A polygon counts as a multipolygon of one; heights are
    dropped; anything else is a reject with its reason. The latest of rows with one key wins
    when there is a `seq` column.

    Borders too long for one row come in parts, if there are the columns `ring_id` and `part`: the rows
    of a key (and `seq`) are LineStrings, which make up each ring in the order of `part`. A part begins
    where the one before ends, the first where the last ends. Ring 0 is the outer one, others are holes.
    An area with a part that is rejected is rejected as a whole; no ring is ever gathered."""
    if "part" in features.columns:
        return _load_parts(features)
    shape = F.from_json("geometry", "struct<type:string,coordinates:string>")
    parsed = features.withColumn("_shape", shape)
    text = F.col("_shape.coordinates")
    parsed = parsed.withColumn(
        "_polygons",
        F.when(F.col("_shape.type") == "Polygon", F.array(F.from_json(text, f"array<{_RING}>")))
        .when(F.col("_shape.type") == "MultiPolygon", F.from_json(text, f"array<array<{_RING}>>")),
    )
    broken = (
        F.col("_polygons").isNull() | (F.size("_polygons") == 0)
        | F.exists("_polygons", lambda p: p.isNull() | (F.size(p) == 0))
    )
    parsed = parsed.withColumn(
        "reason",
        F.when(F.col("_shape.type").isNull(), "no geometry")
        .when(~F.col("_shape.type").isin("Polygon", "MultiPolygon"),
              F.concat(F.lit("geometry must be Polygon or MultiPolygon, got "), F.col("_shape.type")))
        .when(broken, "coordinates cannot be read")
        .when(F.col("name").isNull() | F.col("country_iso2").isNull() | F.col("kind").isNull(), "key is null")
        .when(F.col("admin_level").isNull(), "admin_level is null"),
    )
    rejects = parsed.filter("reason IS NOT NULL").select(*features.columns, "reason")
    latest = F.col("seq").desc() if "seq" in features.columns else F.col("geometry")
    good = first_per_group(parsed.filter("reason IS NULL"), ["name", "country_iso2", "kind"], [latest])
    good = good.withColumn("id", _area_id())
    rings = (
        good.select(F.col("id").alias("area_id"), F.posexplode("_polygons").alias("polygon_id", "rings"))
        .select("area_id", "polygon_id", F.posexplode("rings").alias("ring_id", "ring"))
        .select("area_id", "polygon_id", "ring_id", _ring_edges(F.col("ring"), F.col("ring_id") == 0).alias("edges"))
    )
    edges = with_area_facts(rings.select("area_id", "polygon_id", "ring_id", F.inline("edges")))
    areas = good.select("id", "name", "country_iso2", "kind", "admin_level", "parent_id")
    return areas, edges, rejects


def _load_parts(features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`load_areas` for borders in parts."""
    key, shape = ["name", "country_iso2", "kind"], F.from_json("geometry", "struct<type:string,coordinates:string>")
    version = [*key, *(["seq"] if "seq" in features.columns else [])]
    parsed = features.withColumn("_shape", shape).withColumn(
        "_points", F.when(F.col("_shape.type") == "LineString", F.from_json(F.col("_shape.coordinates"), _RING)))
    broken = F.col("_points").isNull() | (F.size("_points") < 2) | F.exists("_points", lambda p: p.isNull() | (F.size(p) < 2))
    parsed = parsed.withColumn(
        "_own",
        F.when(F.col("_shape.type").isNull(), "no geometry")
        .when(F.col("_shape.type") != "LineString", F.concat(F.lit("a part must be a LineString, got "), F.col("_shape.type")))
        .when(broken, "coordinates cannot be read")
        .when(F.greatest(*[F.col(c).isNull() for c in version]), "key is null")
        .when(F.col("admin_level").isNull(), "admin_level is null")
        .when(F.col("ring_id").isNull() | F.col("part").isNull(), "ring_id or part is null"))
    # A row for each part: where it begins and ends, and twice the size that its edges sweep.
    ends = [F.struct(*[F.get(F.element_at("_points", at), F.lit(i)) for i in (0, 1)]) for at in (1, -1)]
    heads = cut_lineage(parsed.filter(~F.greatest(*[F.col(c).isNull() for c in version])).select(
        *version, "admin_level", "parent_id", "ring_id", "part", "_own", ends[0].alias("_from"), ends[1].alias("_to"),
        once(_between(F.col("_points")), _doubled).alias("_doubled")))
    ring = Window.partitionBy(*version, "ring_id").orderBy("part")
    last = F.last("_to").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    joined = (F.coalesce(F.lag("_to").over(ring), last) == F.col("_from")) & ~F.lag("part").over(ring).eqNullSafe(F.col("part"))
    checked = heads.select("*", F.coalesce("_own", F.when(joined, None).otherwise("parts do not follow each other")).alias("_wrong"))
    versions = checked.groupBy(*version).agg(
        F.min("_wrong").alias("_wrong"), F.min(F.struct("ring_id", "part", "admin_level", "parent_id")).alias("_first"))
    states = cut_lineage(versions)
    bad = states.filter("_wrong IS NOT NULL").select(*version, F.lit("another part cannot be used: ").alias("_why"), "_wrong")
    rejects = lookup_join(parsed, bad, version, ["part"], "left").withColumn(
        "reason", F.coalesce("_own", F.concat("_why", "_wrong"))).filter("reason IS NOT NULL").select(*features.columns, "reason")
    good = first_per_group(states.filter("_wrong IS NULL"), key, [F.col(c).desc() for c in version[3:]] or ["name"]).select(
        *version, "_first.admin_level", "_first.parent_id", _area_id().alias("id"))
    turns = heads.groupBy(*version, "ring_id").agg(((F.sum("_doubled") < 0) == (F.col("ring_id") == 0)).alias("_turn"))
    rings = turns.join(good.select(*version, F.col("id").alias("area_id")), version)
    parts = lookup_join(parsed.filter("_own IS NULL").select(*version, "ring_id", "part", "_points"), rings, [*version, "ring_id"], ["part"])
    edges = parts.select(
        "area_id", F.lit(0).alias("polygon_id"), "ring_id",
        F.inline(once(_between(F.col("_points")), lambda edges: F.when(F.col("_turn"), _turned(edges)).otherwise(edges))))
    return good.select("id", *key, "admin_level", "parent_id"), with_area_facts(edges), rejects


_COORDINATES = ["x1", "y1", "x2", "y2"]


def _twice_size():
    return F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))


def _size(twice):
    # Sums of doubles depend on their order in the last digits; equal areas must stay equal.
    return F.round(F.abs(twice) / 2, 9)


def area_sizes(edges: DataFrame) -> DataFrame:
    """Planar size of each area in square degrees; holes count against it."""
    return edges.groupBy("area_id").agg(_size(_twice_size()).alias("area_size"))


def with_area_facts(edges: DataFrame) -> DataFrame:
    """Edges with the size (`area_size`) of their area and that of the cells of its cover
    (`fineness`). Loaded edges have both, so that spatial joins need not aggregate them again."""
    if {"area_size", "fineness"} <= set(edges.columns):
        return edges
    bare = edges.drop("area_size", "fineness")
    totals = bare.groupBy("area_id").agg(
        _twice_size().alias("_twice"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.expr("sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))")).alias("_length"))
    facts = totals.select("area_id", _size(F.col("_twice")).alias("area_size"), F.expr(fineness("_length", "_n")).alias("fineness"))
    # One row per area on the right; the edges of a large area are a skewed side that Spark splits.
    return bare.join(facts, "area_id")


def _cover(edges: DataFrame, carry) -> tuple[DataFrame, list]:
    """The cover of all areas, and the kinds (fineness, run) of cells that it has; None if these are
    more than KINDS."""
    cells = cut_lineage(area_cells(with_area_facts(edges), carry))
    return cells, small_values(cells, "fineness", "run", rows=KINDS)


def points_in_areas(points: DataFrame, edges: DataFrame, id_col: str = "id", lon: str = "longitude",
                    lat: str = "latitude", carry=()) -> DataFrame:
    """(id, area_id) for every area that holds the point, its border included. A point looks up its
    cell of each kind; every row of the join is one area, so nothing is aggregated. Points without
    coordinates are in no area. `carry` names columns of `edges` that are the same all over an area,
    or `area_size`, to be passed on."""
    cells, _ = _cover(edges, carry)
    return _held(points, cells, id_col, lon, lat, carry)


def _held(points: DataFrame, cells: DataFrame, id_col: str, lon: str, lat: str, carry) -> DataFrame:
    kinds = cells.select("fineness", "run").distinct().agg(F.collect_list(F.struct("fineness", "run")).alias("k")).scalar()
    placed = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(
        id_col, F.col(lon).alias("_px"), F.col(lat).alias("_py"), F.inline(kinds))
    kx, cy = cell_of("_px", "_py", "fineness", "run")
    keyed = placed.selectExpr("*", f"{kx} AS kx", f"{cy} AS cy")
    out = [id_col, "area.area_id", *[F.col("area")[c].alias(c) for c in carry if c != "area_id"]]
    held = lookup_join(keyed, plain(cells), KEYS, id_col, narrow=NARROW).filter(holds_plain("_px", "_py")).select(out)
    rugged = cells.filter("sides IS NULL")
    if rugged.isEmpty():
        return held
    met = lookup_join(keyed, rugged, KEYS, id_col, narrow=NARROW)
    return held.unionAll(met.filter(holds("fineness", "kx", "cy", "odd", "lines", "_px", "_py")).select(out))


def smallest_area(points: DataFrame, edges: DataFrame, id_col: str = "id", **columns) -> DataFrame:
    """(id, area_id): the smallest area that holds the point; of equals the lowest id."""
    return with_first_area(points, edges, "area_size", id_col, **columns).filter("area_id IS NOT NULL").select(id_col, "area_id")


def with_first_area(points: DataFrame, edges: DataFrame, rank: str, id_col: str = "id", out: str = "area_id",
                    lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Points (with unique ids) with the first of the areas that hold them, by a column of the
    edges and then by id; null where there is none. Points are shuffled only if the cells are
    too many to broadcast, or of too many kinds."""
    cells, kinds = _cover(edges, [rank])
    if kinds is None or not skew.fits_broadcast(cells, skew.BROADCAST_ROWS * NARROW):
        pairs = _held(points, cells, id_col, lon, lat, [rank])
        first = pairs.groupBy(id_col).agg(F.min(F.struct(rank, "area_id"))["area_id"].alias(out))
        return points.join(first, id_col, "left")
    found = points
    for k, (level, run) in enumerate(kinds):
        here = cells.filter((F.col("fineness") == level) & (F.col("run") == run)).groupBy(
            F.col("kx").alias(f"__kx{k}"), F.col("cy").alias(f"__cy{k}")).agg(F.collect_list(F.struct("area", "odd", "lines")).alias(f"__areas{k}"))
        kx, cy = cell_of(f"`{lon}`", f"`{lat}`", level, run)
        found = found.join(F.broadcast(here), F.expr(f"{kx} = __kx{k} AND {cy} = __cy{k}"), "left")
    # In order, the first of each kind of cell, and the first of those.
    firsts = [f"array_min(transform(filter(__areas{k}, a -> {holds(level, f'__kx{k}', f'__cy{k}', 'a.odd', 'a.lines', f'`{lon}`', f'`{lat}`')}), a -> a.area))"
              for k, (level, run) in enumerate(kinds)]
    first = f"array_min(array({', '.join(firsts)})).area_id" if firsts else f"CAST(NULL AS {edges.schema['area_id'].dataType.simpleString()})"
    return found.select(*points.columns, F.expr(first).alias(out))


def bounding_box(edges: DataFrame):
    """(west, south, east, north) of all areas, or None without edges."""
    x, y = [F.least("x1", "x2"), F.greatest("x1", "x2")], [F.least("y1", "y2"), F.greatest("y1", "y2")]
    found = edges.agg(F.min(x[0]).alias("x0"), F.min(y[0]).alias("y0"), F.max(x[1]).alias("x1"), F.max(y[1]).alias("y1")).first()
    return None if found["x0"] is None else tuple(found)


def in_box(points: DataFrame, box, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Points in a box, its border included: bounds that a scan can use to skip row groups."""
    if box is None:
        return points.filter(F.lit(False))
    x0, y0, x1, y1 = box
    return points.filter((F.col(lon) >= x0) & (F.col(lon) <= x1) & (F.col(lat) >= y0) & (F.col(lat) <= y1))


def link_poi_areas(pois: DataFrame, areas: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Set `admin_area_id` to the most specific area around each place, a state before a
    country. A place in no area keeps the value it had."""
    linkable = areas.filter(F.col("kind").isin("country", "state")).select(
        F.col("id").alias("area_id"), F.when(F.col("kind") == "state", 0).otherwise(1).alias("rank"))
    borders = lookup_join(edges, linkable, "area_id", _COORDINATES)
    linked = with_first_area(pois, borders, "rank", id_col, out="_area")
    old = F.col("admin_area_id") if "admin_area_id" in pois.columns else F.lit(None).cast("string")
    return linked.withColumn("admin_area_id", F.coalesce("_area", old)).drop("_area")


def _ring_starts(edges: DataFrame) -> DataFrame:
    """One vertex per ring: enough to tell containment when no borders meet."""
    ring = [c for c in ("area_id", "country_iso2", "side", "polygon_id", "ring_id") if c in edges.columns]
    return edges.groupBy(F.struct(*ring).alias("ring")).agg(F.min(F.struct("x1", "y1")).alias("v")).select(
        "ring", F.col("v.x1").alias("longitude"), F.col("v.y1").alias("latitude"))


# Edges of one cell may make so many pairs; cells with more are split into 8 by 8.
PAIRS = 4096
_SPLIT = 8
_DEPTH = 5


def _in_cells(edges: DataFrame, size: float) -> DataFrame:
    """Edges (area_id, country_iso2, ends) in every cell that they touch."""
    placed = touched(edges.select("area_id", "country_iso2", *_COORDINATES), f"{size!r}D")
    return placed.selectExpr("country_iso2", "explode(sequence(cx_from, cx_to)) AS cx", "cy", "area_id", *_ENDS)


def _split_cells(rows: DataFrame, size: float) -> DataFrame:
    """The same for the parts of cells: edges in the cells of that smaller size within their cell."""
    kept = ["country_iso2", "area_id", *_ENDS]
    inside = rows.selectExpr(
        *kept, "cx", f"greatest(cy * {_SPLIT}, bigint(ceil(ay / {size!r}D)) - 1) AS _first",
        f"least(cy * {_SPLIT} + {_SPLIT - 1}, bigint(floor(by / {size!r}D))) AS _last").filter("_first <= _last")
    placed = inside.selectExpr(*kept, "cx", "explode(sequence(_first, _last)) AS cy")
    first, last = columns_in_row(f"{size!r}D", "cy")
    ranged = placed.selectExpr(
        *kept, "cy", f"greatest(cx * {_SPLIT}, {first}) AS _first", f"least(cx * {_SPLIT} + {_SPLIT - 1}, {last}) AS _last").filter("_first <= _last")
    return ranged.selectExpr("country_iso2", "explode(sequence(_first, _last)) AS cx", "cy", "area_id", *_ENDS)


_ENDS = ("ax", "ay", "bx", "by")
_CELL = ["country_iso2", "cx", "cy"]


def border_pairs(left: DataFrame, right: DataFrame, cell: float = CELL, pairs: int = PAIRS) -> DataFrame:
    """(left_id, right_id) of areas in one country whose borders share a point. Edges meet in grid
    cells. Where those of a cell make more than `pairs` pairs, the cell is split, again and again; at
    the last size what still is too much (many edges through one spot) is spread over salts."""
    out, size = None, cell
    sides = [_in_cells(e, size) for e in (left, right)]
    for depth in range(_DEPTH + 1):
        counts = [s.groupBy(*_CELL).agg(F.count(F.lit(1)).alias(n)) for s, n in zip(sides, ("l", "r"), strict=True)]
        shared = cut_lineage(counts[0].join(counts[1], _CELL).withColumn("dense", F.col("l") * F.col("r") > pairs))
        last = depth == _DEPTH
        here = (shared if last else shared.filter("NOT dense")).select(*_CELL)
        l, r = (s.join(here, _CELL, "left_semi").select(*_CELL, *[F.col(c).alias(p + c) for c in ("area_id", *_ENDS)])
                for s, p in zip(sides, ("l_", "r_"), strict=True))
        both = lookup_join(l, r, _CELL, ["l_area_id", "l_ax", "l_ay"]) if last else l.join(r, _CELL)
        met = both.filter(segments_meet(*[[p + c for c in _ENDS] for p in ("l_", "r_")])).select(
            F.col("l_area_id").alias("left_id"), F.col("r_area_id").alias("right_id"))
        out = met if out is None else out.unionByName(met)
        dense, size = shared.filter("dense").select(*_CELL), size / _SPLIT
        if last or dense.isEmpty():
            return out.distinct()
        sides = [cut_lineage(_split_cells(s.join(dense, _CELL, "left_semi"), size)) for s in sides]


def areas_meet(left: DataFrame, right: DataFrame, edges: DataFrame, cell: float = CELL) -> DataFrame:
    """(left_id, right_id) of areas in one country that share a point. `left` and `right` have
    (id, country_iso2). Either a ring of one starts inside the other, or some border edges meet; these
    are compared only for areas on the left that are not known to meet all of their country."""
    sides = left.select(F.col("id").alias("area_id"), "country_iso2", F.lit(0).alias("side")).unionByName(
        right.select(F.col("id").alias("area_id"), "country_iso2", F.lit(1).alias("side")))
    # Read six times below.
    borders = cut_lineage(with_area_facts(lookup_join(edges, sides, "area_id", _COORDINATES)))
    # A ring has one start, so few points are looked up: larger cells are enough.
    coarse = borders.withColumn("fineness", F.col("fineness") - 3)
    starts = points_in_areas(_ring_starts(borders), coarse, "ring", carry=["country_iso2", "side"]).filter(
        "ring.country_iso2 = country_iso2 AND ring.side <> side")
    held = cut_lineage(starts.selectExpr(
        "if(side = 1, ring.area_id, area_id) AS left_id", "if(side = 1, area_id, ring.area_id) AS right_id").distinct())
    there = right.groupBy("country_iso2").agg(F.count(F.lit(1)).alias("there"))
    met = held.groupBy(F.col("left_id").alias("id")).agg(F.count(F.lit(1)).alias("met"))
    unsettled = left.select("id", "country_iso2").join(there, "country_iso2").join(met, "id", "left").filter(
        F.coalesce("met", F.lit(0)) < F.col("there")).select(F.col("id").alias("area_id"))
    rest = borders.filter("side = 0").join(unsettled, "area_id", "left_semi")
    return held.unionByName(border_pairs(rest, borders.filter("side = 1"), cell)).distinct()


def link_area_parents(areas: DataFrame, edges: DataFrame, cell: float = CELL) -> DataFrame:
    """Give each state without a parent the country it meets; of several the lowest id."""
    orphans = areas.filter("kind = 'state' AND parent_id IS NULL")
    pairs = areas_meet(orphans, areas.filter("kind = 'country'"), edges, cell)
    parents = pairs.groupBy(F.col("left_id").alias("id")).agg(F.min("right_id").alias("_parent"))
    return areas.join(parents, "id", "left").withColumn(
        "parent_id", F.coalesce("parent_id", "_parent")).drop("_parent")
