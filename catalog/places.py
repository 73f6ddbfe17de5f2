"""Queries on places: roles, themes, filters, spatial joins, candidates and search."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalog.base import ROLE_ORDER, THEME_ORDER, geodesic_sql, load, ordered
from catalog.registry import query
from placeweave.functions import geo, scoring, trigram
from placeweave.operators import areas as A
from placeweave.operators import candidates as C
from placeweave.operators import poi as P
from placeweave.operators import search as S
from placeweave.operators.search_many import search_locations_many

SEED = (98.5, 3.25)


def role_map(spark, sf):
    return load(spark, sf, "SELECT category, role FROM role_map")


def theme_map(spark, sf):
    return load(spark, sf, "SELECT theme, category FROM theme_map")


def plain_pois(spark, sf):
    df = load(spark, sf, "SELECT * FROM pois")
    return df.withColumns({
        "categories": F.split("categories_csv", ","), "images": F.split("images_csv", ","),
    }).drop("categories_csv", "images_csv")


def pois(spark, sf):
    return P.with_roles(plain_pois(spark, sf), role_map(spark, sf))


def themed(spark, sf):
    return P.with_themes(pois(spark, sf), theme_map(spark, sf), out="all_themes")


def areas(spark, sf):
    return load(spark, sf, "SELECT id, name, kind, admin_level, country_iso2, parent_id FROM areas")


def edges(spark, sf):
    return load(spark, sf, "SELECT * FROM edges")


def _double(*columns):
    return {c: F.col(c).cast("double") for c in columns}


@query(f"SELECT id, {ordered('roles', ROLE_ORDER)} AS roles FROM o_poi")
def derive_roles(spark, sf):
    return pois(spark, sf).select("id", F.array_join("poi_roles", ",").alias("roles"))


@query(f"SELECT id, {ordered('themes', THEME_ORDER)} AS themes FROM o_poi")
def derive_themes(spark, sf):
    return themed(spark, sf).select("id", F.array_join("all_themes", ",").alias("themes"))


@query("SELECT id FROM o_poi WHERE list_has_any(roles, ['meal', 'accommodation'])")
def role_filter(spark, sf):
    return pois(spark, sf).filter(C.role_filter(["meal", "accommodation"])).select("id")


@query("SELECT id, review_count FROM pois WHERE review_rating >= 3.0 AND review_count >= 500")
def rating_floor(spark, sf):
    return plain_pois(spark, sf).filter(C.rating_floor(3.0, 500)).select("id", "review_count")


@query("""SELECT id FROM o_poi WHERE list_has_any(roles, ['meal', 'accommodation'])
          OR list_has_any(themes, ['nature', 'shopping', 'cultural_history'])""")
def theme_gate(spark, sf):
    return themed(spark, sf).filter(C.theme_gate(["nature", "shopping", "cultural_history"])).select("id")


@query("""SELECT id FROM o_poi WHERE NOT list_contains(roles, 'attraction')
          OR NOT list_has_any(themes, ['adventure', 'nightlife'])""")
def excluded_themes(spark, sf):
    return themed(spark, sf).filter(C.theme_exclusion(["adventure", "nightlife"])).select("id")


@query("""SELECT id FROM o_poi WHERE NOT list_contains(roles, 'meal')
          OR (coalesce(halal_food, false) AND (coalesce(vegetarian_options, false) OR coalesce(vegan_options, false)))""")
def dietary_filter(spark, sf):
    return pois(spark, sf).filter(C.dietary_filter(halal=True, vegetarian=True)).select("id")


@query("""SELECT id FROM pois WHERE coalesce(wheelchair_accessible_entrance, false)
          OR coalesce(wheelchair_accessible_seating, false) OR coalesce(wheelchair_accessible_toilet, false)""")
def wheelchair_filter(spark, sf):
    return plain_pois(spark, sf).filter(C.wheelchair_filter(True)).select("id")


@query("""SELECT id FROM o_poi WHERE NOT list_has_any(roles, ['attraction', 'meal']) OR coalesce(kids_friendly, false)""")
def kids_filter(spark, sf):
    return pois(spark, sf).filter(C.company_filter("kids_friendly", True)).select("id")


@query("""SELECT id FROM o_poi WHERE NOT list_has_any(roles, ['attraction', 'meal']) OR coalesce(pets_friendly, false)""")
def pets_filter(spark, sf):
    return pois(spark, sf).filter(C.company_filter("pets_friendly", True)).select("id")


@query("SELECT id, round(quality_score, 6) AS quality_score FROM o_poi")
def quality_score(spark, sf):
    return plain_pois(spark, sf).select(
        "id", F.round(scoring.quality_score("review_rating", "review_count"), 6).alias("quality_score"))


@query("SELECT id, CASE WHEN list_contains(roles, 'attraction') AND list_has_any(themes, ['family', 'nature']) THEN 1 ELSE 0 END AS theme_match FROM o_poi")
def theme_match(spark, sf):
    return themed(spark, sf).select(
        "id", scoring.theme_match("poi_roles", "all_themes", ["family", "nature"]).alias("theme_match"))


@query(f"SELECT id, round(distance_m, 3) AS distance_m FROM ({geodesic_sql('pois', 'longitude', 'latitude', *SEED)})")
def geodesic_distance(spark, sf):
    metres = geo.distance("longitude", "latitude", *SEED)
    return plain_pois(spark, sf).select("id", F.round(metres, 3).alias("distance_m"))


@query("SELECT id, CASE WHEN longitude IS NULL OR latitude IS NULL THEN NULL ELSE CAST(round(longitude * 1000) AS BIGINT) || ' ' || CAST(round(latitude * 1000) AS BIGINT) END AS point FROM pois")
def derive_point(spark, sf):
    df = plain_pois(spark, sf).select("id", P.point().alias("p"))
    def milli(c):
        return F.round(F.col(c) * 1000).cast("bigint").cast("string")
    return df.select("id", F.when(F.col("p").isNotNull(), F.concat(milli("p.lon"), F.lit(" "), milli("p.lat"))).alias("point"))


@query("""SELECT p.id, b.id AS area_id FROM pois p JOIN boxes b
          ON p.longitude BETWEEN b.x0 AND b.x1 AND p.latitude BETWEEN b.y0 AND b.y1""")
def pip_join(spark, sf):
    return A.points_in_areas(plain_pois(spark, sf), edges(spark, sf))


@query("""SELECT p.id, d.id AS area_id FROM pois p JOIN districts d
          ON abs(p.longitude - d.cx) + abs(p.latitude - d.cy) <= 1
          AND NOT (abs(p.longitude - d.cx) < 0.2 AND abs(p.latitude - d.cy) < 0.2)""")
def pip_districts(spark, sf):
    return A.points_in_areas(plain_pois(spark, sf), load(spark, sf, "SELECT * FROM district_edges"))


# Points on and beside the slanted border of a triangle, in tenths of a degree as they are written:
# neither the points nor the border's line are exact as doubles.
BORDER_POINTS = """SELECT c_custkey AS id, CAST(96.1 + (c_custkey % 13) / 10.0 AS DECIMAL(9, 4)) AS x,
    CAST(1.3 + (c_custkey % 13) * 0.075 + CASE c_custkey % 5 WHEN 1 THEN 0.0001 WHEN 2 THEN -0.0001 ELSE 0 END AS DECIMAL(9, 4)) AS y FROM customer"""
TRIANGLE = (("96.1", "1.3"), ("97.3", "2.2"), ("96.1", "2.2"))


@query(f"""SELECT count(*) FILTER (x BETWEEN 96.1 AND 97.3 AND y BETWEEN 1.3 AND 2.2 AND 1.2 * (y - 1.3) >= 0.9 * (x - 96.1)) AS held,
                  count(*) FILTER (x BETWEEN 96.1 AND 97.3 AND y BETWEEN 1.3 AND 2.2 AND 1.2 * (y - 1.3) = 0.9 * (x - 96.1)) AS on_border, count(*) AS points
           FROM ({BORDER_POINTS})""")
def points_on_borders(spark, sf):
    """Places in a triangle, and on its slanted border, by coordinates that are decimals."""
    points = load(spark, sf, BORDER_POINTS).select("id", *[F.col(c).cast("double").alias(n) for c, n in (("x", "longitude"), ("y", "latitude"))])
    ring = [f"struct(double({a}) AS x1, double({b}) AS y1, double({c}) AS x2, double({d}) AS y2)"
            for (a, b), (c, d) in zip(TRIANGLE, TRIANGLE[1:] + TRIANGLE[:1], strict=True)]
    borders = spark.range(1).selectExpr("'t' AS area_id", f"inline(array({', '.join(ring)}))")
    held = A.points_in_areas(points, borders)
    slant = [f"{c}D" for c in (*TRIANGLE[0], *TRIANGLE[1])]
    on = F.expr(f"{geo.side_sql(*slant, 'longitude', 'latitude')} = 0 AND {geo.within_sql(*slant, 'longitude', 'latitude')}")
    marked = points.join(held, "id", "left")
    return marked.agg(F.count("area_id").alias("held"), F.count(F.when(on, 1)).alias("on_border"), F.count(F.lit(1)).alias("points"))


@query("SELECT id, area_id FROM o_smallest")
def smallest_area(spark, sf):
    return A.smallest_area(plain_pois(spark, sf), edges(spark, sf))


@query("SELECT id AS area_id, CAST(1.84 AS DOUBLE) AS area_size FROM districts")
def area_sizes(spark, sf):
    sizes = A.area_sizes(load(spark, sf, "SELECT * FROM district_edges"))
    return sizes.select("area_id", F.round("area_size", 6).alias("area_size"))


@query("""SELECT p.id, coalesce(h.area_id, p.admin_area_id) AS admin_area_id FROM pois p LEFT JOIN (
            SELECT p.id, coalesce(min(CASE WHEN b.kind = 'state' THEN b.id END), min(b.id)) AS area_id
            FROM pois p JOIN boxes b ON p.longitude BETWEEN b.x0 AND b.x1 AND p.latitude BETWEEN b.y0 AND b.y1
            GROUP BY p.id) h ON h.id = p.id""")
def link_poi_areas(spark, sf):
    linked = A.link_poi_areas(plain_pois(spark, sf), areas(spark, sf), edges(spark, sf))
    return linked.select("id", "admin_area_id")


@query("""SELECT s.id, s.kind, coalesce(s.parent_id, p.parent) AS parent_id FROM squares s LEFT JOIN (
            SELECT a.id, min(c.id) AS parent FROM squares a JOIN squares c ON a.kind = 'state' AND c.kind = 'country'
              AND a.country_iso2 = c.country_iso2 AND a.x0 <= c.x1 AND c.x0 <= a.x1 AND a.y0 <= c.y1 AND c.y0 <= a.y1
            WHERE a.parent_id IS NULL GROUP BY a.id) p ON p.id = s.id""")
def link_area_parents(spark, sf):
    table = load(spark, sf, "SELECT id, kind, country_iso2, parent_id FROM squares")
    linked = A.link_area_parents(table, load(spark, sf, "SELECT * FROM square_edges"))
    return linked.select("id", "kind", "parent_id")


GEOJSON = """
SELECT s_name AS name, 'R' || CAST(s_nationkey % 4 AS STRING) AS country_iso2, 'district' AS kind,
       CASE WHEN s_suppkey % 29 = 0 THEN NULL ELSE 6 END AS admin_level, CAST(NULL AS STRING) AS parent_id,
       CASE s_suppkey % 5
         WHEN 0 THEN '{"type":"Point","coordinates":[1,2]}'
         WHEN 1 THEN '{"type":"Polygon","coordinates":[[[0,0],[0,' || CAST(1 + s_suppkey % 7 AS STRING) || '],[2,' || CAST(1 + s_suppkey % 7 AS STRING) || '],[2,0],[0,0]]]}'
         WHEN 2 THEN '{"type":"MultiPolygon","coordinates":[[[[0,0,9],[3,0,9],[3,3,9],[0,3,9],[0,0,9]],[[1,1,9],[2,1,9],[2,2,9],[1,2,9],[1,1,9]]],[[[5,5],[6,5],[6,7],[5,5]]]]}'
         WHEN 3 THEN 'not json'
         ELSE '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[1,3],[3,3],[3,1],[1,1]]]}' END AS geometry
FROM supplier
"""


@query("""SELECT s_name AS name,
            CASE WHEN s_suppkey % 5 = 3 THEN 'no geometry' WHEN s_suppkey % 5 = 0 THEN 'geometry must be Polygon or MultiPolygon, got Point'
                 WHEN s_suppkey % 29 = 0 THEN 'admin_level is null' ELSE 'ok' END AS status,
            CASE WHEN s_suppkey % 5 IN (0, 3) OR s_suppkey % 29 = 0 THEN 0.0E0 WHEN s_suppkey % 5 = 1 THEN 2.0E0 * (1 + s_suppkey % 7)
                 WHEN s_suppkey % 5 = 2 THEN 9.0E0 ELSE 12.0E0 END AS area_size,
            CAST(CASE WHEN s_suppkey % 5 IN (0, 3) OR s_suppkey % 29 = 0 THEN 0 WHEN s_suppkey % 5 = 1 THEN 4
                 WHEN s_suppkey % 5 = 2 THEN 11 ELSE 8 END AS BIGINT) AS edges
          FROM supplier""")
def geojson_ingest(spark, sf):
    loaded, borders, rejects = A.load_areas(load(spark, sf, GEOJSON))
    per_area = borders.groupBy("area_id").agg(F.count(F.lit(1)).alias("edges"))
    good = loaded.join(A.area_sizes(borders), loaded.id == F.col("area_id")).drop("area_id").join(
        per_area, F.col("id") == F.col("area_id"))
    return good.select("name", F.lit("ok").alias("status"), F.round("area_size", 6).alias("area_size"), "edges").unionByName(
        rejects.select("name", F.col("reason").alias("status"), F.lit(0.0).alias("area_size"), F.lit(0).cast("bigint").alias("edges")))


RING_POINTS = """SELECT o_orderpriority AS name, o_orderkey AS place, CAST(o_orderkey % 360 - 180 AS BIGINT) AS x,
    CAST(o_custkey % 170 - 85 AS BIGINT) AS y FROM orders"""
# A part of a border has the points of so many order keys.
PART_KEYS = 50_000


@query(f"""SELECT name, count(*) AS edges, round(abs(sum(x * y2 - x2 * y)) / 2.0E0, 6) AS area_size FROM (
             SELECT name, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
             FROM ({RING_POINTS}) WINDOW w AS (PARTITION BY name ORDER BY place)) GROUP BY name""")
def geojson_long_rings(spark, sf):
    """One boundary per order priority, with a point for each of its orders. It comes in parts, each of
    which ends where the next one begins."""
    points = load(spark, sf, RING_POINTS).withColumn("part", F.floor(F.col("place") / PART_KEYS))
    lines = points.groupBy("name", "part").agg(F.sort_array(F.collect_list(F.struct("place", "x", "y"))).alias("line"))
    # One row per part.
    starts = points.groupBy("name", "part").agg(F.min(F.struct("place", "x", "y")).alias("start"))
    ring = Window.partitionBy("name").orderBy("part")
    ends = starts.select("name", "part", F.coalesce(F.lead("start").over(ring), F.first("start").over(ring)).alias("end"))
    line = F.transform(F.concat("line", F.array("end")), lambda p: F.array(p["x"], p["y"]))
    features = lines.join(ends, ["name", "part"]).select(
        "name", F.lit("R0").alias("country_iso2"), F.lit("district").alias("kind"), F.lit(6).alias("admin_level"),
        F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("ring_id"), "part",
        F.to_json(F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))).alias("geometry"))
    loaded, borders, _ = A.load_areas(features)
    sizes = borders.groupBy("area_id").agg(F.count(F.lit(1)).alias("edges")).join(A.area_sizes(borders), "area_id")
    return loaded.join(sizes, loaded.id == F.col("area_id")).select("name", "edges", F.round("area_size", 6).alias("area_size"))


def _scored(spark, sf):
    all_areas = A.smallest_area(plain_pois(spark, sf), edges(spark, sf))
    df = P.with_themes(pois(spark, sf), theme_map(spark, sf)).join(all_areas, "id")
    rows = C.role_rows(C.score(df, ["nature", "family"], *SEED), ["attraction", "meal", "accommodation"])
    return rows.select("id", "area_id", "role_pick", "theme_match", "quality_score", "distance_m")


_ROWS = f"""SELECT d.id, s.area_id, r.role AS role_pick, d.quality_score, d.distance_m,
    CASE WHEN list_contains(d.roles, 'attraction') AND list_has_any(d.themes, ['nature', 'family']) THEN 1 ELSE 0 END AS theme_match
  FROM ({geodesic_sql('o_poi', 'longitude', 'latitude', *SEED)}) d JOIN o_smallest s ON s.id = d.id,
       unnest(d.roles) AS r(role)"""
_ORDER = "theme_match DESC, quality_score DESC, coalesce(distance_m, 1e9), id"
_CAPPED = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role_pick, area_id ORDER BY {_ORDER}) AS rn_area FROM ({_ROWS})) WHERE rn_area <= 6"


@query(f"SELECT id, role_pick, area_id, rn_area FROM ({_CAPPED})")
def cap_per_area(spark, sf):
    return C.cap_per_area(_scored(spark, sf), 6).select("id", "role_pick", "area_id", F.col("rn_area").cast("bigint").alias("rn_area"))


@query(f"""SELECT id, role_pick, rn_role FROM (
             SELECT *, row_number() OVER (PARTITION BY role_pick ORDER BY {_ORDER}) AS rn_role,
                    row_number() OVER (PARTITION BY id ORDER BY CASE role_pick WHEN 'attraction' THEN 1 WHEN 'meal' THEN 2 ELSE 3 END) AS rn_id
             FROM ({_CAPPED}))
           WHERE rn_id = 1 AND rn_role <= CASE role_pick WHEN 'attraction' THEN 30 WHEN 'meal' THEN 25 ELSE 10 END""")
def role_quota(spark, sf):
    chosen = C.take_quota(C.cap_per_area(_scored(spark, sf), 6), {"attraction": 30, "meal": 25, "accommodation": 10})
    return chosen.select("id", "role_pick", F.col("rn_role").cast("bigint").alias("rn_role"))


@query(f"""SELECT id, CASE min(CASE role_pick WHEN 'attraction' THEN 1 WHEN 'meal' THEN 2 ELSE 3 END)
             WHEN 1 THEN 'attraction' WHEN 2 THEN 'meal' ELSE 'accommodation' END AS role_pick
           FROM ({_ROWS}) GROUP BY id""")
def one_role_per_poi(spark, sf):
    return C.rank_ids(_scored(spark, sf)).filter("rn_id = 1").select("id", "role_pick")


WANT = C.CandidateFilter(
    themes=("nature", "shopping", "cultural_history"), min_rating=2.0, min_reviews=10,
    vegetarian_only=True, excluded_themes=("nightlife",))


@query(f"""
SELECT id, name, replace(categories_csv, ',', '|') AS categories,
       CASE WHEN list_contains(roles, 'attraction') THEN {ordered('themes', THEME_ORDER)} ELSE '' END AS themes,
       {ordered('roles', ROLE_ORDER)} AS roles, review_count, CAST(review_rating AS DOUBLE) AS review_rating, latitude, longitude,
       CASE WHEN images_csv IS NULL THEN '' ELSE split_part(images_csv, ',', 1) END AS images,
       open_hours, kids_friendly, pets_friendly, wheelchair_accessible_entrance, wheelchair_accessible_seating, wheelchair_accessible_toilet,
       halal_food, vegan_options, vegetarian_options, role_pick, area_name, round(distance_m, 3) AS distance_m
FROM (
  SELECT *, row_number() OVER (PARTITION BY role_pick ORDER BY {_ORDER}) AS rn_role,
         row_number() OVER (PARTITION BY id ORDER BY CASE role_pick WHEN 'attraction' THEN 1 WHEN 'meal' THEN 2 ELSE 3 END) AS rn_id
  FROM (SELECT *, row_number() OVER (PARTITION BY role_pick, area_id ORDER BY {_ORDER}) AS rn_area FROM (
    SELECT d.*, c.area_id, c.area_name, r.role AS role_pick,
      CASE WHEN list_contains(d.roles, 'attraction') AND list_has_any(d.themes, ['nature', 'shopping', 'cultural_history']) THEN 1 ELSE 0 END AS theme_match
    FROM ({geodesic_sql('o_poi', 'longitude', 'latitude', *SEED)}) d
    JOIN (SELECT id, area_id, area_name FROM (
            SELECT p.id, b.id AS area_id, b.name AS area_name,
                   row_number() OVER (PARTITION BY p.id ORDER BY (b.x1 - b.x0) * (b.y1 - b.y0), b.id) AS rn
            FROM pois p JOIN boxes b ON (b.id = 'C2' OR b.parent_id = 'C2')
              AND p.longitude BETWEEN b.x0 AND b.x1 AND p.latitude BETWEEN b.y0 AND b.y1) WHERE rn = 1) c ON c.id = d.id,
      unnest(d.roles) AS r(role)
    WHERE d.review_rating >= 2.0 AND d.review_count >= 10
      AND (list_has_any(d.roles, ['accommodation', 'meal']) OR list_has_any(d.themes, ['nature', 'shopping', 'cultural_history']))
      AND (NOT list_contains(d.roles, 'meal') OR coalesce(d.vegetarian_options, false) OR coalesce(d.vegan_options, false))
      AND (NOT list_contains(d.roles, 'attraction') OR NOT list_contains(d.themes, 'nightlife'))))
  WHERE rn_area <= 8)
WHERE rn_id = 1 AND rn_role <= CASE role_pick WHEN 'attraction' THEN 20 WHEN 'meal' THEN 12 ELSE 9 END""")
def poi_candidates(spark, sf):
    found = C.poi_candidates(
        pois(spark, sf), areas(spark, sf), edges(spark, sf), theme_map(spark, sf), "asia, Anywhere",
        quota_attraction=20, quota_meal=12, quota_accommodation=9, want=WANT, per_area_cap=8,
        seed_lon=SEED[0], seed_lat=SEED[1])
    return found.select(
        "id", "name", F.array_join("categories", "|").alias("categories"), F.array_join("themes", ",").alias("themes"),
        F.array_join("roles", ",").alias("roles"), "review_count", F.col("review_rating").cast("double").alias("review_rating"),
        "latitude", "longitude", F.array_join("images", ",").alias("images"), "open_hours", "kids_friendly", "pets_friendly",
        "wheelchair_accessible_entrance", "wheelchair_accessible_seating", "wheelchair_accessible_toilet", "halal_food",
        "vegan_options", "vegetarian_options", "role_pick", "area_name", F.round("distance_m", 3).alias("distance_m"))


def _grams(text: str) -> str:
    """DuckDB: the set of trigrams of a text."""
    words = f"list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda w: w <> '')"
    return (f"list_distinct(flatten(list_transform({words}, lambda w: "
            f"list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))")


def _sim(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))))"


@query(f"SELECT doc_id, round({_sim('g', 'q')}, 6) AS sim FROM (SELECT c_custkey AS doc_id, {_grams('c_name')} AS g, {_grams(chr(39) + 'customer 00000042' + chr(39))} AS q FROM customer)")
def trigram_similarity(spark, sf):
    df = load(spark, sf, "SELECT c_custkey AS doc_id, c_name FROM customer")
    wanted = trigram.trigrams(F.lit("customer 00000042"))
    return df.select("doc_id", F.round(trigram.similarity(trigram.trigrams("c_name"), wanted), 6).alias("sim"))


@query(f"""SELECT id, name, CASE WHEN kind = 'country' THEN name ELSE name || ', ' || CASE country_iso2 WHEN 'SG' THEN 'Singapore' WHEN 'MY' THEN 'Malaysia' ELSE country_iso2 END END AS label,
             kind, country_iso2, parent_id, admin_level
           FROM (SELECT *, {_sim('g', 'q')} AS sim, lower(name) LIKE 'customer town 0000001%' AS prefix
                 FROM (SELECT *, {_grams('name')} AS g, {_grams(chr(39) + 'customer town 0000001' + chr(39))} AS q FROM places))
           WHERE sim >= 0.3 OR prefix ORDER BY prefix DESC, sim DESC, length(name), id LIMIT 25""")
def search_locations(spark, sf):
    table = load(spark, sf, "SELECT * FROM places")
    return S.search_locations(table, "Customer Town 0000001", limit=25)


@query(f"""SELECT id, name, country_iso2, admin_level
           FROM (SELECT *, {_sim('g', 'q')} AS sim, lower(name) LIKE 'supplier#00%' AS prefix
                 FROM (SELECT *, {_grams('name')} AS g, {_grams(chr(39) + 'supplier#00' + chr(39))} AS q FROM places))
           WHERE sim >= 0.3 OR prefix ORDER BY id LIMIT 12""")
def search_locations_by_id(spark, sf):
    found = S.search_locations(load(spark, sf, "SELECT * FROM places"), "supplier#00", 12, order="as_coded")
    return found.select("id", "name", "country_iso2", "admin_level")


# What many users type: the beginnings of names, names with a letter wrong, and words of them.
ASKED = """SELECT substring(c_name, 1, 3 + c_custkey % 15) AS query FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT replace(s_name, '0', 'O') FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT lower(n_name) || ' town' FROM nation UNION ALL SELECT '' UNION ALL SELECT NULL UNION ALL SELECT n_name FROM nation"""


@query(f"""WITH asked AS (SELECT DISTINCT query FROM ({ASKED}) WHERE query IS NOT NULL),
           q AS (SELECT query, {_grams('query')} AS q FROM asked), n AS (SELECT id, name, {_grams('name')} AS g FROM places),
           r AS (SELECT query, id, starts_with(lower(name), lower(query)) AS prefix, length(name) AS len,
                        CASE WHEN len(list_concat(g, q)) = 0 THEN 0 ELSE {_sim('g', 'q')} END AS sim FROM q, n),
           k AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY prefix DESC, sim DESC, len, id) AS rank FROM r WHERE prefix OR sim >= 0.3)
           SELECT query, CAST(rank AS BIGINT) AS rank, id FROM k WHERE rank <= 7""")
def search_many(spark, sf):
    """The best areas for each of many texts, in one join."""
    found = search_locations_many(load(spark, sf, "SELECT * FROM places"), load(spark, sf, ASKED), limit=7)
    return found.select("query", F.col("rank").cast("bigint").alias("rank"), "id")


DEEP = 0.6


@query(f"""SELECT id, review_count, CAST((SELECT count(*) FROM pois) AS BIGINT) AS total_count FROM pois
           ORDER BY review_count DESC NULLS LAST, review_rating DESC NULLS LAST, id LIMIT 30 OFFSET (SELECT CAST(floor(count(*) * {DEEP}) AS BIGINT) FROM pois)""")
def deep_page(spark, sf):
    """A page far down the list of places, without sorting all of them."""
    df = plain_pois(spark, sf).select("id", "review_count", "review_rating")
    page, total = S.page_of(df, int(df.count() * DEEP), 30, rows=500)
    return page.select("id", "review_count", F.lit(total).cast("bigint").alias("total_count"))


def _listed(df):
    return df.select(
        "id", "name", F.array_join("categories", ",").alias("categories"), "address", F.array_join("roles", ",").alias("roles"),
        "review_count", F.col("review_rating").cast("double").alias("review_rating"), "descriptions", "vegan_options",
        F.col("latitude").isNull().alias("no_point"), "total_count")


def _list_sql(where: str, limit: int, offset: int) -> str:
    return f"""SELECT id, name, categories_csv AS categories, address, {ordered('roles', ROLE_ORDER)} AS roles, review_count,
                 CAST(review_rating AS DOUBLE) AS review_rating, descriptions, vegan_options, true AS no_point,
                 (SELECT count(*) FROM o_poi WHERE {where}) AS total_count
               FROM o_poi WHERE {where}
               ORDER BY o_poi.review_count DESC NULLS LAST, o_poi.review_rating DESC NULLS LAST, id LIMIT {limit} OFFSET {offset}"""


@query(_list_sql("admin_area_id IN ('C1', 'S1', 'S6', 'S11', 'S16', 'S21') AND list_has_any(roles, ['meal', 'attraction'])", 40, 7))
def search_pois_list(spark, sf):
    return _listed(S.search_pois(pois(spark, sf), areas(spark, sf), theme_map(spark, sf), "list", "Nowhere, my",
                                 ["meal", "attraction"], limit=40, offset=7))


@query(_list_sql("(name ILIKE '%old%' OR descriptions ILIKE '%old%' OR address ILIKE '%old%')", 50, 0))
def search_pois_text(spark, sf):
    return _listed(S.search_pois(pois(spark, sf), areas(spark, sf), theme_map(spark, sf), "search", query="OLD", limit=50))


@query(f"""SELECT id, name, {ordered('themes', THEME_ORDER)} AS themes, {ordered('roles', ROLE_ORDER)} AS roles,
             CASE WHEN images_csv IS NULL THEN '' ELSE split_part(images_csv, ',', 1) END AS images, latitude, longitude
           FROM (SELECT *, {_sim('g', 'q')} AS sim, {_sim('g1', 'q')} AS sim_cat, name LIKE 'old gizmo%' AS prefix
                 FROM (SELECT *, {_grams('name')} AS g, {_grams("split_part(categories_csv, ',', 1)")} AS g1, {_grams(chr(39) + 'old gizmo' + chr(39))} AS q FROM o_poi))
           WHERE (sim >= 0.3 OR prefix OR sim_cat >= 0.3) AND sim > 0 AND list_has_any(roles, ['attraction'])
           ORDER BY prefix DESC, sim DESC, review_rating DESC NULLS LAST, review_count DESC NULLS LAST, id LIMIT 60""")
def search_pois_minimal(spark, sf):
    found = S.search_pois(pois(spark, sf), areas(spark, sf), theme_map(spark, sf), "search_minimal",
                          roles=["attraction"], query="Old Gizmo", limit=60)
    return found.select("id", "name", F.array_join("themes", ",").alias("themes"), F.array_join("roles", ",").alias("roles"),
                        F.array_join("images", ",").alias("images"), "latitude", "longitude")
