import pytest

from placeweave.operators import candidates as C
from placeweave.operators import checks, poi
from placeweave.operators import search as S

AREAS = [("c1", "Malaysia", "MY", "country", None, 2), ("s1", "Johor", "MY", "state", "c1", 4), ("s2", "Penang", "MY", "state", "c1", 4),
         ("c2", "Singapore", "SG", "country", None, 2), ("t1", "Johor", "MY", "city", "s1", 6)]
ROLE_PAIRS = [("cafe", "meal"), ("hotel", "accommodation"), ("park", "attraction"), ("zoo", "attraction"), ("pub", "meal"), ("pub", "attraction")]
THEME_PAIRS = [("nature", "park"), ("family", "zoo"), ("family", "park"), ("nightlife", "pub")]


@pytest.fixture(scope="module")
def areas(spark):
    return spark.createDataFrame(AREAS, "id string, name string, country_iso2 string, kind string, parent_id string, admin_level int")


@pytest.fixture(scope="module")
def edges(spark):
    boxes = [("c1", 0, 0, 10, 10), ("s1", 0, 0, 5, 10), ("s2", 5, 0, 10, 10), ("c2", 20, 0, 30, 10), ("t1", 0, 0, 1, 1)]
    rows = []
    for a, x0, y0, x1, y1 in boxes:
        ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        rows += [(a, 0, float(p), float(q), float(r), float(s)) for (p, q), (r, s) in zip(ring, ring[1:])]
    return spark.createDataFrame(rows, "area_id string, ring_id int, x1 double, y1 double, x2 double, y2 double")


@pytest.fixture(scope="module")
def role_map(spark):
    return spark.createDataFrame(ROLE_PAIRS, "category string, role string")


@pytest.fixture(scope="module")
def theme_map(spark):
    return spark.createDataFrame(THEME_PAIRS, "theme string, category string")


POI = ("id int, name string, categories array<string>, review_rating decimal(2,1), review_count int, longitude double, latitude double, "
       "halal_food boolean, vegan_options boolean, vegetarian_options boolean, kids_friendly boolean, admin_area_id string, images array<string>, "
       "address string, descriptions string")


def make(spark, role_map, rows):
    from decimal import Decimal

    full = []
    for i, name, cats, rating, n, lon, lat, extra in rows:
        e = {"halal": None, "vegan": None, "veg": None, "kids": None, "area": None, "images": None, "address": None, "text": None, **extra}
        full.append((i, name, cats, None if rating is None else Decimal(str(rating)), n, lon if lon is None else float(lon), lat if lat is None else float(lat), e["halal"], e["vegan"], e["veg"], e["kids"], e["area"],
                     e["images"], e["address"], e["text"]))
    return poi.with_roles(spark.createDataFrame(full, POI), role_map)


def test_roles_and_themes(spark, role_map, theme_map):
    df = make(spark, role_map, [
        (1, "a", ["cafe", "hotel"], 4, 10, 1, 1, {}), (2, "b", ["pub", "park"], 4, 10, 1, 1, {}), (3, "c", [], 4, 10, 1, 1, {}),
        (4, "d", None, 4, 10, 1, 1, {}), (5, "e", ["none"], 4, 10, 1, 1, {}), (6, "f", ["hotel", "pub", "hotel"], 4, 10, 1, 1, {})])
    got = {r["id"]: (r["poi_roles"], r["themes"]) for r in poi.with_themes(df, theme_map).collect()}
    assert got == {1: (["accommodation"], []), 2: (["meal", "attraction"], ["family", "nature", "nightlife"]), 3: ([], []), 4: ([], []),
                   5: ([], []), 6: (["accommodation", "attraction"], ["nightlife"])}


def test_roles_and_themes_with_long_maps(spark, role_map, theme_map, no_literals_no_broadcast):
    test_roles_and_themes(spark, role_map, theme_map)


@pytest.fixture(scope="module")
def places(spark, role_map):
    return make(spark, role_map, [
        (1, "Old Park", ["park"], 4.5, 1000, 2.0, 2.0, {"kids": True, "area": "s1", "images": ["i1", "i2"], "address": "Main_Road"}),
        (2, "New Park", ["park"], 4.5, 900, 2.5, 2.0, {"area": "s1", "text": "An OLD place"}), (3, "Zoo", ["zoo"], 4.5, 800, 6.0, 2.0, {"area": "s2"}),
        (4, "Pub", ["pub"], 4.5, 700, 2.0, 3.0, {"vegan": True, "area": "s1"}), (5, "Cafe", ["cafe"], 4.0, 600, 2.0, 3.0, {"halal": True, "area": "s1", "images": []}),
        (6, "Hotel", ["hotel"], 3.0, 500, 7.0, 7.0, {"area": "s2"}), (7, "Low", ["park"], 1.9, 500, 2.0, 2.0, {"area": "s1"}),
        (8, "Few", ["park"], 4.5, 9, 2.0, 2.0, {"area": "s1"}), (9, "No point", ["park"], 4.5, 500, None, None, {}),
        (10, "Abroad", ["park"], 4.5, 5000, 25.0, 5.0, {"area": "c2"}), (11, "Unrated", ["park"], None, 500, 2.0, 2.0, {"area": "c1"}),
        (12, "Twin", ["park"], 4.5, 1000, 2.0, 2.0, {"area": "s1"}),
    ])


def pick(places, areas, edges, theme_map, dest="Malaysia", quotas=(10, 10, 10), **kw):
    found = C.poi_candidates(places, areas, edges, theme_map, dest, *quotas, **kw)
    assert found.columns == list(C.OUTPUT)
    return {r["id"]: r for r in found.collect()}


def test_candidates_choose_filter_and_fill(places, areas, edges, theme_map):
    got = pick(places, areas, edges, theme_map)
    assert {i: r["role_pick"] for i, r in got.items()} == {
        1: "attraction", 2: "attraction", 3: "attraction", 4: "attraction", 5: "meal", 6: "accommodation", 12: "attraction"}
    assert got[1]["area_name"] == "Johor" and got[3]["area_name"] == "Penang" and got[1]["distance_m"] is None
    assert got[1]["images"] == ["i1"] and got[5]["images"] == [] and got[2]["images"] == []
    assert got[4]["themes"] == ["nightlife"] and got[5]["themes"] == []
    assert got[1]["wheelchair_accessible_entrance"] is None and got[1]["open_hours"] is None
    assert pick(places, areas, edges, theme_map, include_images=False)[1]["images"] == []


def test_candidate_filters(places, areas, edges, theme_map):
    def ids(**kw):
        return set(pick(places, areas, edges, theme_map, want=C.CandidateFilter(**kw)))
    assert ids(themes=("family",)) == {1, 2, 3, 4, 5, 6, 12}
    assert ids(themes=("relax",)) == {4, 5, 6} and ids(themes=()) == {1, 2, 3, 4, 5, 6, 12}
    assert ids(halal_only=True) == {1, 2, 3, 5, 6, 12} and ids(vegetarian_only=True) == {1, 2, 3, 4, 6, 12}
    assert ids(kids_friendly_only=True) == {1, 6} and ids(pets_friendly_only=True) == {6} and ids(wheelchair_only=True) == set()
    assert ids(excluded_themes=("nightlife", "whatever")) == {1, 2, 3, 5, 6, 12}
    assert ids(roles=("meal", "meal")) == {4, 5} and ids(min_rating=4.5, min_reviews=900) == {1, 2, 12}
    with pytest.raises(ValueError):
        C.CandidateFilter(themes=("unknown",))


def test_quota_counts_rows_of_places_taken_by_another_role(places, areas, edges, theme_map):
    # The pub is the first meal by quality, but goes out as an attraction, or not at all.
    got = pick(places, areas, edges, theme_map, quotas=(2, 1, 1))
    assert {i: r["role_pick"] for i, r in got.items()} == {1: "attraction", 12: "attraction", 6: "accommodation"}
    got = pick(places, areas, edges, theme_map, quotas=(9, 2, 0))
    assert {i for i, r in got.items() if r["role_pick"] == "meal"} == {5} and 6 not in got


def test_cap_and_order(places, areas, edges, theme_map):
    got = pick(places, areas, edges, theme_map, per_area_cap=1)
    # The pub is cut as an attraction, so it stays as the best meal of its area.
    assert {i: r["role_pick"] for i, r in got.items()} == {1: "attraction", 3: "attraction", 4: "meal", 6: "accommodation"}
    near = pick(places, areas, edges, theme_map, per_area_cap=1, seed_lon=7.0, seed_lat=7.0)
    assert set(near) == {1, 3, 4, 6} and near[6]["distance_m"] == 0.0
    themed = pick(places, areas, edges, theme_map, quotas=(1, 0, 0), want=C.CandidateFilter(themes=("nightlife",)))
    assert set(themed) == {4}


def test_destinations(places, areas, edges, theme_map):
    assert set(pick(places, areas, edges, theme_map, "mala%, x")) == {1, 2, 3, 4, 5, 6, 12}
    # Of a state and a city with one name the city ranks first.
    assert set(pick(places, areas, edges, theme_map, "Johor")) == set()
    assert set(pick(places, areas, edges, theme_map, " PENANG ,Malaysia")) == {3, 6}
    assert pick(places, areas, edges, theme_map, "Nowhere") == {} and pick(places, areas, edges, theme_map, None) == {}
    assert C.like_pattern(r"a\b\%") == r"ab\%"
    with pytest.raises(ValueError):
        C.like_pattern("a\\")


def search(places, areas, theme_map, *args, **kw):
    found = S.search_pois(places, areas, theme_map, *args, **kw)
    assert found.columns == list(S.RESULT)
    return found.collect()


def test_list_mode(places, areas, theme_map):
    rows = search(places, areas, theme_map, "list", "Malaysia", limit=3, offset=1)
    assert [r["id"] for r in rows] == [12, 2, 3] and {r["total_count"] for r in rows} == {10}
    assert rows[0]["latitude"] is None and rows[0]["themes"] is None and rows[0]["roles"] == ["attraction"]
    assert [r["id"] for r in search(places, areas, theme_map, "list", "Johor", ["meal"])] == [4, 5]
    assert {r["id"] for r in search(places, areas, theme_map, "list", "Nowhere, SG")} == {10}
    assert {r["id"] for r in search(places, areas, theme_map, "list", "Nowhere, singapore")} == {10}
    assert search(places, areas, theme_map, "list", "Nowhere") == [] and search(places, areas, theme_map, "odd") == []
    assert len(search(places, areas, theme_map, limit=50)) == 12
    assert search(places, areas, theme_map, "list", offset=50) == []


def test_search_mode(places, areas, theme_map):
    assert {r["id"] for r in search(places, areas, theme_map, "search", query="oLd")} == {1, 2}
    assert {r["id"] for r in search(places, areas, theme_map, "search", query="p_rk", limit=50)} == {1, 2}
    assert len(search(places, areas, theme_map, "search", limit=50)) == 12


def test_minimal_mode(places, areas, theme_map):
    rows = search(places, areas, theme_map, "search_minimal", query="new p", limit=5)
    assert rows[0]["id"] == 2 and rows[0]["themes"] == ["family", "nature"] and rows[0]["review_count"] is None and rows[0]["total_count"] is None
    # The category "park" matches, but a name without a shared trigram is dropped.
    assert {r["id"] for r in search(places, areas, theme_map, "search_minimal", query="park", limit=50)} == {1, 2, 9}
    assert [r["id"] for r in search(places, areas, theme_map, "search_minimal", limit=2)] == [10, 1]
    assert rows[0]["images"] == []


def test_locations(areas):
    assert [r["label"] for r in S.search_locations(areas, "jo").collect()] == ["Johor, Malaysia", "Johor, Malaysia"]
    assert [r["label"] for r in S.search_locations(areas, "Singapura").collect()] == ["Singapore"]
    assert [r["id"] for r in S.search_locations(areas, "%", limit=2, order="as_coded").collect()] == ["c1", "c2"]
    assert S.search_locations(areas, "zzz").collect() == []


def test_checks(spark):
    rows = [(1, "A@b.Co", "abc"), (2, "a@b", "ab"), (3, None, None), (4, "x+y%z@a-b.org", "A_9")]
    valid, rejects = checks.split_valid(spark.createDataFrame(rows, "id int, email string, username string"), checks.user_rules())
    assert {r["id"] for r in valid.collect()} == {1, 4}
    assert {r["id"]: r["reasons"] for r in rejects.collect()} == {2: ["email format", "username format"], 3: ["email is null", "username is null"]}
    roles = spark.createDataFrame([("meal",), ("x",), (None,)], "role string")
    assert checks.split_valid(roles, checks.role_rules())[1].count() == 2
    pois = spark.createDataFrame([("l", "n"), (None, "n")], "google_map_link string, name string")
    assert checks.split_valid(pois, checks.poi_rules())[0].count() == 1


def test_derive_poi(spark, role_map):
    from decimal import Decimal

    df = spark.createDataFrame([("u", "n", "['Park ', 'x']", "7", "4.25", "bad", None, "{}", "{'a': 'b'}"), (None, "n", None, None, None, None, None, None, None)],
                               "link string, name string, categories string, review_count string, review_rating string, latitude string, kids_friendly boolean, open_hours string, complete_address string")
    rows = poi.derive_poi(df, role_map).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["categories"] == ["park", "x"] and r["review_count"] == 7 and r["review_rating"] == Decimal("4.3") and r["latitude"] is None
    assert r["kids_friendly"] is False and r["open_hours"] is None and r["complete_address"] == '{"a":"b"}' and r["poi_roles"] == ["attraction"]
    assert r["point"] is None and len(r["id"]) == 64
