"""Place, area and trip tables derived from the driver's tables.

The text of each is the same for Spark and for the oracle, so both sides start from one input.
"""

import os
import re

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

CTE = {}

CTE["pois"] = """
SELECT p.p_partkey AS id,
       'https://maps.example/' || CAST(p.p_partkey AS STRING) AS google_map_link,
       p.p_name AS name,
       lower(p.p_type) || ',' || replace(p.p_name, ' ', ',') AS categories_csv,
       CAST(CASE WHEN p.p_partkey % 53 = 0 THEN NULL ELSE l.n * p.p_size END AS INT) AS review_count,
       CAST(CASE WHEN p.p_partkey % 59 = 0 THEN NULL ELSE 1 + (p.p_partkey % 41) / 10.0 END AS DECIMAL(2,1)) AS review_rating,
       CASE WHEN p.p_partkey % 97 = 0 THEN NULL ELSE ((p.p_partkey * 7919) % 10500) / 1000.0E0 END AS latitude,
       CASE WHEN p.p_partkey % 97 = 0 THEN NULL ELSE 95.0E0 + ((p.p_partkey * 104729) % 26000) / 1000.0E0 END AS longitude,
       CASE WHEN p.p_partkey % 31 = 0 THEN NULL ELSE 'S' || CAST(p.p_partkey % 25 AS STRING) END AS admin_area_id,
       CASE WHEN p.p_partkey % 4 = 0 THEN NULL ELSE 'A ' || lower(p.p_type) || ' place by ' || p.p_brand END AS descriptions,
       CASE WHEN p.p_partkey % 6 = 0 THEN NULL ELSE CAST(p.p_size AS STRING) || ' ' || split_part(p.p_name, ' ', 1) || ' street' END AS address,
       CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE 'https://img.example/' || CAST(p.p_partkey AS STRING) || '/a,https://img.example/' || CAST(p.p_partkey AS STRING) || '/b' END AS images_csv,
       CASE WHEN p.p_partkey % 13 = 0 THEN NULL ELSE p.p_size % 2 = 0 END AS halal_food,
       CASE WHEN p.p_partkey % 13 = 0 THEN NULL ELSE p.p_size % 3 = 0 END AS vegan_options,
       p.p_size % 7 = 0 AS vegetarian_options,
       CASE WHEN p.p_partkey % 17 = 0 THEN NULL ELSE p.p_size % 5 = 0 END AS kids_friendly,
       CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE 'from ' || CAST(p.p_size AS STRING) END AS open_hours,
       p.p_size % 4 = 0 AS pets_friendly,
       p.p_partkey % 6 = 0 AS wheelchair_accessible_entrance,
       CASE WHEN p.p_partkey % 19 = 0 THEN NULL ELSE p.p_partkey % 10 = 0 END AS wheelchair_accessible_seating,
       p.p_partkey % 15 = 0 AS wheelchair_accessible_toilet,
       p.p_partkey % 9 = 0 AS wheelchair_accessible_car_park
FROM part p
JOIN (SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey) l ON l.l_partkey = p.p_partkey
"""

CTE["role_map"] = """
SELECT DISTINCT split_part(p_name, ' ', 2) AS category,
       CASE split_part(p_name, ' ', 2) WHEN 'plate' THEN 'meal' WHEN 'ring' THEN 'accommodation' ELSE 'attraction' END AS role
FROM part
UNION SELECT DISTINCT lower(p_type), 'meal' FROM part WHERE p_type = 'PROMO'
"""

CTE["theme_map"] = """
SELECT DISTINCT CASE split_part(p_name, ' ', 2) WHEN 'widget' THEN 'shopping' WHEN 'gizmo' THEN 'family'
         WHEN 'bolt' THEN 'nature' WHEN 'anvil' THEN 'art_museums' ELSE 'adventure' END AS theme,
       split_part(p_name, ' ', 2) AS category
FROM part WHERE split_part(p_name, ' ', 2) NOT IN ('plate', 'ring')
UNION SELECT DISTINCT CASE split_part(p_name, ' ', 1) WHEN 'old' THEN 'cultural_history' ELSE 'nightlife' END,
       split_part(p_name, ' ', 1)
FROM part WHERE split_part(p_name, ' ', 1) IN ('old', 'hot')
"""

# Countries are the regions and states the nations, both rectangles.
CTE["boxes"] = """
SELECT 'C' || CAST(r_regionkey AS STRING) AS id, r_name AS name, 'country' AS kind, 2 AS admin_level,
       CASE r_regionkey WHEN 0 THEN 'SG' WHEN 1 THEN 'MY' ELSE 'R' || CAST(r_regionkey AS STRING) END AS country_iso2,
       CAST(NULL AS STRING) AS parent_id,
       95.0E0 + 5 * r_regionkey AS x0, 100.0E0 + 5 * r_regionkey AS x1, 0.0E0 AS y0, 10.0E0 AS y1
FROM region
UNION ALL
SELECT 'S' || CAST(n_nationkey AS STRING), n_name, 'state', 4,
       CASE n_regionkey WHEN 0 THEN 'SG' WHEN 1 THEN 'MY' ELSE 'R' || CAST(n_regionkey AS STRING) END,
       'C' || CAST(n_regionkey AS STRING),
       95.0E0 + 5 * n_regionkey, 100.0E0 + 5 * n_regionkey,
       2.0E0 * CAST(FLOOR(n_nationkey / 5.0E0) AS INT), 2.0E0 + 2.0E0 * CAST(FLOOR(n_nationkey / 5.0E0) AS INT)
FROM nation
"""
CTE["areas"] = "SELECT id, name, kind, admin_level, country_iso2, parent_id FROM boxes"


def _rectangle(source: str) -> str:
    """Edges of boxes as they are after loading, with the facts of their area."""
    facts = "(x1 - x0) * (y1 - y0) AS area_size, CAST(-floor(log2((x1 - x0 + y1 - y0) / 24)) AS INT) AS fineness"
    return f"""
SELECT id AS area_id, 0 AS ring_id, x0 AS x1, y0 AS y1, x1 AS x2, y0 AS y2, {facts} FROM {source}
UNION ALL SELECT id, 0, x1, y0, x1, y1, {facts} FROM {source}
UNION ALL SELECT id, 0, x1, y1, x0, y1, {facts} FROM {source}
UNION ALL SELECT id, 0, x0, y1, x0, y0, {facts} FROM {source}
"""


CTE["edges"] = _rectangle("boxes")

# One district per supplier: a diamond of half-width 1 with a square hole of half-width 0.2.
# The odd offsets keep every place off the slanted borders.
CTE["districts"] = """
SELECT s_suppkey AS id, s_name AS name, s_nationkey,
       96.00037E0 + (s_suppkey * 37) % 240 / 10.0E0 AS cx, 1.00061E0 + (s_suppkey * 53) % 90 / 10.0E0 AS cy
FROM supplier
"""
CTE["district_edges"] = """
SELECT id AS area_id, 0 AS ring_id, cx + 1 AS x1, cy AS y1, cx AS x2, cy + 1 AS y2 FROM districts
UNION ALL SELECT id, 0, cx, cy + 1, cx - 1, cy FROM districts
UNION ALL SELECT id, 0, cx - 1, cy, cx, cy - 1 FROM districts
UNION ALL SELECT id, 0, cx, cy - 1, cx + 1, cy FROM districts
UNION ALL SELECT id, 1, cx - 0.2E0, cy - 0.2E0, cx - 0.2E0, cy + 0.2E0 FROM districts
UNION ALL SELECT id, 1, cx - 0.2E0, cy + 0.2E0, cx + 0.2E0, cy + 0.2E0 FROM districts
UNION ALL SELECT id, 1, cx + 0.2E0, cy + 0.2E0, cx + 0.2E0, cy - 0.2E0 FROM districts
UNION ALL SELECT id, 1, cx + 0.2E0, cy - 0.2E0, cx - 0.2E0, cy - 0.2E0 FROM districts
"""

# Parentless states, one square per supplier, beside the countries of `boxes`.
CTE["squares"] = """
SELECT 'C' || CAST(r_regionkey AS STRING) AS id, r_name AS name, 'country' AS kind,
       'R' || CAST(r_regionkey % 2 AS STRING) AS country_iso2, CAST(NULL AS STRING) AS parent_id,
       95.0E0 + 5 * r_regionkey AS x0, 100.0E0 + 5 * r_regionkey AS x1, 0.0E0 AS y0, 10.0E0 AS y1
FROM region
UNION ALL
SELECT 'T' || CAST(s_suppkey AS STRING), s_name, 'state', 'R' || CAST(s_nationkey % 2 AS STRING),
       CASE WHEN s_suppkey % 9 = 0 THEN 'C9' ELSE NULL END,
       94.0E0 + (s_suppkey * 37) % 260 / 10.0E0, 94.5E0 + (s_suppkey * 37) % 260 / 10.0E0,
       (s_suppkey * 53) % 110 / 10.0E0, 0.5E0 + (s_suppkey * 53) % 110 / 10.0E0
FROM supplier
"""
CTE["square_edges"] = _rectangle("squares")

CTE["listings"] = """
SELECT 'https://maps.example/' || lpad(CAST(p_partkey AS STRING), 9, '0') AS link,
       p_name || CASE WHEN p_partkey % 3 = 0 THEN ' @ ' || p_brand WHEN p_partkey % 101 = 1 THEN ' Flagship Store' ELSE '' END AS title,
       CASE p_partkey % 4 WHEN 0 THEN '{"country":"SG"}' WHEN 1 THEN '{"state":"Johor","country":"MY"}'
            WHEN 2 THEN '{"state":"Penang","country":"MY"}' ELSE NULL END AS complete_address,
       CAST(CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE (p_partkey * 31) % 160 END AS INT) AS review_count,
       CASE WHEN p_partkey % 59 = 0 THEN NULL ELSE 1 + (p_partkey % 41) / 10.0E0 END AS review_rating,
       p_partkey, p_name, p_type, p_brand, p_size
FROM part
"""

# Listings as they are scraped: some without a link, some that share one, some twice.
CTE["scraped"] = """
SELECT CASE p_partkey % 11 WHEN 3 THEN NULL WHEN 5 THEN 'https://maps.example/shared' ELSE link END AS link, title, complete_address, review_count, review_rating
FROM listings
UNION ALL SELECT link, title, complete_address, review_count, review_rating FROM listings WHERE p_partkey % 7 = 2 AND p_partkey % 11 NOT IN (3, 5)
"""

CTE["patterns"] = """
SELECT DISTINCT upper(split_part(p_name, ' ', 2)) AS pattern FROM part WHERE split_part(p_name, ' ', 2) IN ('widget', 'ring', 'bolt')
UNION SELECT DISTINCT p_name FROM part WHERE split_part(p_name, ' ', 1) = 'cold'
UNION SELECT DISTINCT substring(p_name, 2, 2) FROM part WHERE split_part(p_name, ' ', 1) = 'red'
UNION SELECT DISTINCT p_brand FROM part
"""

CTE["lines"] = "SELECT doc_id, text FROM documents"

CTE["phones"] = """
SELECT c_custkey, c_name, c_mktsegment,
       CASE c_custkey % 10
         WHEN 0 THEN '+65' || CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN chr(160) ELSE '\u3000' END || '6' || lpad(CAST(c_custkey % 40 AS STRING), 7, '0')
         WHEN 1 THEN '07-' || lpad(CAST(c_custkey AS STRING), 7, '0')
         WHEN 2 THEN '8' || lpad(CAST(c_custkey % 40 AS STRING), 7, '0')
         WHEN 3 THEN '12 ' || lpad(CAST(c_custkey AS STRING), 7, '0')
         WHEN 4 THEN '60-12.' || lpad(CAST(c_custkey AS STRING), 7, '0')
         WHEN 5 THEN '6' || lpad(CAST(c_custkey % 40 AS STRING), 7, '0') || '.0'
         WHEN 6 THEN 'n/a ' || CAST(c_custkey AS STRING)
         WHEN 7 THEN NULL
         WHEN 8 THEN '(65) 9/' || lpad(CAST(c_custkey AS STRING), 7, '0')
         ELSE '2' || lpad(CAST(c_custkey AS STRING), 7, '0') END AS phone
FROM customer
"""

CTE["guide"] = """
SELECT s_name AS name,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE '+65' || CASE WHEN s_suppkey % 2 = 0 THEN '6' ELSE '8' END
         || lpad(CAST(s_suppkey % 60 AS STRING), 7, '0') END AS phone,
       CASE s_suppkey % 3 WHEN 0 THEN '$$$' WHEN 1 THEN '100-200 SGD' ELSE NULL END AS price,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'Guide text ' || s_name END AS description,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'g' || CAST(s_suppkey AS STRING) || '-1 , g' || CAST(s_suppkey AS STRING) || '-2' END AS images,
       -s_suppkey AS seq
FROM supplier
"""

CTE["cat_labels"] = """
SELECT c_custkey, c_acctbal, lower(c_mktsegment) || ' ' || CASE c_custkey % 7 WHEN 0 THEN 'Repair' WHEN 1 THEN 'supply' WHEN 2 THEN 'hardware'
         WHEN 3 THEN 'park' WHEN 4 THEN 'Wet_Market' WHEN 5 THEN 'Shop & Bar' ELSE 'temple' END
       || ' ' || CAST(c_custkey AS STRING) AS label
FROM customer
"""
CTE["assignments"] = """
SELECT o.o_orderkey AS seq, l.label,
       CASE WHEN o.o_orderkey % 23 = 0 THEN '' WHEN o.o_orderkey % 19 = 0 THEN 'exclude' WHEN o.o_orderkey % 17 = 0 THEN 'unique'
            WHEN o.o_orderkey % 13 = 0 THEN 'exclude,attractions/nature' WHEN o.o_orderkey % 11 = 0 THEN 'unique,meal'
            ELSE CASE o.o_orderstatus WHEN 'F' THEN 'attractions/shopping' WHEN 'O' THEN 'meal,attractions/nightlife' ELSE 'accommodation' END END AS buckets_csv
FROM orders o JOIN cat_labels l ON l.c_custkey = o.o_custkey AND l.c_acctbal >= 0
"""

CTE["itineraries"] = """
SELECT o_orderkey AS id, o_orderdate AS created_at, o_orderdate AS updated_at,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey * 7) % 150 END AS user_id,
       'Trip ' || CAST(o_orderkey AS STRING) AS title,
       '["' || o_orderpriority || '"]' AS destinations, '{}' AS dates, '{"adults":2}' AS travelers, '{}' AS preferences,
       '{}' AS flags, '[]' AS hotels, '[]' AS mandatory_pois, '[]' AS ideas, '{"days":' || CAST(o_orderkey % 9 AS STRING) || '}' AS plan,
       CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'archived' ELSE 'deleted' END AS status
FROM orders
"""
CTE["reads"] = """
SELECT event_id AS request_id, event_id * 2 AS id,
       CASE WHEN event_id % 3 = 0 THEN (event_id * 14) % 150 WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id
FROM events
"""
CTE["changes"] = """
SELECT event_id AS seq, (event_id % 1000) * 20 AS id,
       CASE (event_id + 3 * CAST(FLOOR(event_id / 1000.0E0) AS BIGINT)) % 9
         WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'upsert' WHEN 3 THEN 'delete' WHEN 4 THEN 'update_meta'
         WHEN 5 THEN 'update_plan' WHEN 6 THEN 'claim' WHEN 7 THEN 'soft_delete' ELSE 'claim' END AS op,
       CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN ((event_id % 1000) * 140) % 150 ELSE user_id % 4 END AS user_id,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'Title ' || CAST(event_id AS STRING) END AS title,
       CASE WHEN event_id % 5 = 0 THEN '["d' || CAST(event_id AS STRING) || '"]' ELSE NULL END AS destinations,
       CASE WHEN event_id % 6 = 0 THEN '{"from":' || CAST(event_id AS STRING) || '}' ELSE NULL END AS dates,
       CASE WHEN event_id % 7 < 3 THEN NULL ELSE '{"p":' || CAST(event_id AS STRING) || '}' END AS plan,
       CASE WHEN event_id % 8 = 0 THEN 'archived' ELSE NULL END AS status
FROM events
"""

CTE["users"] = """
SELECT c_custkey AS id,
       CASE WHEN c_custkey % 12 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN lower(c_name) || '@example.com'
            WHEN c_custkey % 7 = 0 THEN 'user.' || CAST(c_custkey AS STRING) || '@example'
            ELSE 'User+' || CAST(c_custkey AS STRING) || '@Example.co' END AS email,
       CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 6 = 0 THEN c_name
            WHEN c_custkey % 9 = 0 THEN 'ab' ELSE 'User_' || CAST(c_custkey AS STRING) END AS username
FROM customer
"""

# Areas for the name search: countries, states, and a city for each customer and supplier.
CTE["places"] = """
SELECT id, name, kind, country_iso2, parent_id, admin_level FROM boxes
UNION ALL SELECT 'K' || CAST(c_custkey AS STRING), replace(c_name, '#', ' town '), 'city',
       CASE c_nationkey % 3 WHEN 0 THEN 'SG' WHEN 1 THEN 'MY' ELSE 'R2' END, 'S' || CAST(c_nationkey AS STRING), 8 FROM customer
UNION ALL SELECT 'U' || CAST(s_suppkey AS STRING), s_name, 'city', 'MY', 'S' || CAST(s_nationkey AS STRING), 8 FROM supplier
"""


def _needed(text: str, found: list) -> list:
    """Names of the derived tables a text uses, inner ones first."""
    for word in re.findall(r"\b[a-z_]+\b", re.sub(r"'[^']*'", "", text)):
        if word in CTE and word not in found and re.search(rf"(?i)\b(?:from|join)\s+{word}\b", text):
            _needed(CTE[word], found)
            if word not in found:
                found.append(word)
    return found


def with_tables(body: str) -> str:
    """The query with the derived tables it uses in front. `body` may start with its own WITH."""
    names = _needed(body, [])
    if not names:
        return body
    head = ", ".join(f"{n} AS ({CTE[n].strip()})" for n in names)
    body = body.strip()
    if re.match(r"(?i)with recursive\b", body):
        return f"WITH RECURSIVE {head}, {body[len('with recursive'):].lstrip()}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {head}, {body[len('with'):].lstrip()}"
    return f"WITH {head} {body}"


def load(spark, sf_dir: str, body: str):
    """Run a query over the driver's tables and the derived ones with Spark."""
    text = with_tables(body)
    for t in TABLES:
        if re.search(rf"(?i)\b(?:from|join)\s+{t}\b", text):
            spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")).createOrReplaceTempView(t)
    return spark.sql(text)


# The rest is for oracles only.
CTE["o_roles"] = """
SELECT id, list(DISTINCT role) AS raw
FROM (SELECT p.id, unnest(string_split(p.categories_csv, ',')) AS category FROM pois p) c JOIN role_map m USING (category)
GROUP BY id
"""
CTE["o_themes"] = """
SELECT id, list(DISTINCT theme) AS themes
FROM (SELECT p.id, unnest(string_split(p.categories_csv, ',')) AS category FROM pois p) c JOIN theme_map m USING (category)
GROUP BY id
"""
CTE["o_poi"] = """
SELECT p.*, coalesce(t.themes, []) AS themes,
       CASE WHEN list_contains(r.raw, 'accommodation') THEN list_filter(r.raw, lambda x: x <> 'meal') ELSE coalesce(r.raw, []) END AS roles,
       coalesce(CAST(review_rating AS DOUBLE) / 5.0, 0) * 0.2
         + least(ln(greatest(coalesce(review_count, 1), 1)) / ln(100000), 1.0) * 0.8 AS quality_score
FROM pois p LEFT JOIN o_roles r USING (id) LEFT JOIN o_themes t USING (id)
"""
CTE["o_smallest"] = """
SELECT id, area_id, area_name FROM (
  SELECT p.id, b.id AS area_id, b.name AS area_name,
         row_number() OVER (PARTITION BY p.id ORDER BY (b.x1 - b.x0) * (b.y1 - b.y0), b.id) AS rn
  FROM pois p JOIN boxes b ON p.longitude BETWEEN b.x0 AND b.x1 AND p.latitude BETWEEN b.y0 AND b.y1) z
WHERE rn = 1
"""

THEME_ORDER = (
    "['religious_sites','adventure','art_museums','family','nature','nightlife','relax','shopping','cultural_history','food_culinary']"
)
ROLE_ORDER = "['meal','accommodation','attraction']"


def ordered(values: str, order: str) -> str:
    """DuckDB text of a list as comma-separated text in a declared order."""
    return f"array_to_string(list_filter({order}, lambda v: list_contains({values}, v)), ',')"


def geodesic_sql(source: str, lon: str, lat: str, seed_lon: float, seed_lat: float, rounds: int = 8) -> str:
    """Vincenty's inverse formula as nested queries over `source`, adding distance_m."""
    a, f = "6378137.0E0", "(1 / 298.257223563E0)"
    b = f"({a} * (1 - {f}))"
    sql = (f"SELECT *, atan((1 - {f}) * tan(radians({lat}))) AS v_u1, atan((1 - {f}) * tan(radians({seed_lat}E0))) AS v_u2, "
           f"radians({seed_lon}E0 - {lon}) AS v_dl, radians({seed_lon}E0 - {lon}) AS v_l FROM {source}")
    for i in range(rounds):
        sql = (f"SELECT * EXCLUDE (v_l), v_l AS v_k{i}, sqrt((cos(v_u2) * sin(v_l)) ** 2 + (cos(v_u1) * sin(v_u2) - sin(v_u1) * cos(v_u2) * cos(v_l)) ** 2) AS v_ss{i}, "
               f"sin(v_u1) * sin(v_u2) + cos(v_u1) * cos(v_u2) * cos(v_l) AS v_cs{i} FROM ({sql})")
        sql = (f"SELECT *, atan2(v_ss{i}, v_cs{i}) AS v_sg{i}, CASE WHEN v_ss{i} = 0 THEN 0 ELSE cos(v_u1) * cos(v_u2) * sin(v_k{i}) / v_ss{i} END AS v_sa{i} FROM ({sql})")
        sql = (f"SELECT *, 1 - v_sa{i} ** 2 AS v_c2{i}, CASE WHEN 1 - v_sa{i} ** 2 = 0 THEN 0 ELSE v_cs{i} - 2 * sin(v_u1) * sin(v_u2) / (1 - v_sa{i} ** 2) END AS v_cm{i} FROM ({sql})")
        sql = f"SELECT *, {f} / 16 * v_c2{i} * (4 + {f} * (4 - 3 * v_c2{i})) AS v_cc{i} FROM ({sql})"
        sql = (f"SELECT *, v_dl + (1 - v_cc{i}) * {f} * v_sa{i} * (v_sg{i} + v_cc{i} * v_ss{i} * (v_cm{i} + v_cc{i} * v_cs{i} * (2 * v_cm{i} ** 2 - 1))) AS v_l FROM ({sql})")
    i = rounds - 1
    sql = f"SELECT *, v_c2{i} * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS v_q FROM ({sql})"
    sql = (f"SELECT *, 1 + v_q / 16384 * (4096 + v_q * (-768 + v_q * (320 - 175 * v_q))) AS v_a, "
           f"v_q / 1024 * (256 + v_q * (-128 + v_q * (74 - 47 * v_q))) AS v_b FROM ({sql})")
    return (f"SELECT * EXCLUDE (v_q), {b} * v_a * (v_sg{i} - v_b * v_ss{i} * (v_cm{i} + v_b / 4 * (v_cs{i} * (2 * v_cm{i} ** 2 - 1) "
            f"- v_b / 6 * v_cm{i} * (4 * v_ss{i} ** 2 - 3) * (4 * v_cm{i} ** 2 - 3)))) AS distance_m FROM ({sql})")
