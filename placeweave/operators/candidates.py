"""Choosing places for a trip: filters, scores, caps per area and quotas per role."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.constants import THEMES
from placeweave.functions import geo, media, scoring
from placeweave.operators.areas import bounding_box, in_box, with_first_area
from placeweave.operators.poi import has_role, with_themes
from placeweave.operators.skew import BROADCAST_ROWS, lookup_join, small_values, top_per_group

PAYLOAD = (
    "name", "categories", "open_hours", "review_count", "review_rating", "latitude", "longitude",
    "kids_friendly", "pets_friendly", "wheelchair_accessible_entrance",
    "wheelchair_accessible_seating", "wheelchair_accessible_toilet", "halal_food",
    "vegan_options", "vegetarian_options",
)
OUTPUT = (
    "id", "name", "categories", "themes", "roles", "open_hours", "review_count", "review_rating",
    "latitude", "longitude", "images", "kids_friendly", "pets_friendly",
    "wheelchair_accessible_entrance", "wheelchair_accessible_seating",
    "wheelchair_accessible_toilet", "halal_food", "vegan_options", "vegetarian_options",
    "role_pick", "area_name", "distance_m",
)


@dataclass(frozen=True)
class CandidateFilter:
    """What a traveller asks for. None or () for `themes` means any theme."""

    themes: tuple[str, ...] | None = None
    roles: tuple[str, ...] = ("attraction", "meal", "accommodation")
    min_rating: float = 2.0
    min_reviews: int = 10
    halal_only: bool = False
    vegetarian_only: bool = False
    vegan_only: bool = False
    wheelchair_only: bool = False
    kids_friendly_only: bool = False
    pets_friendly_only: bool = False
    excluded_themes: tuple[str, ...] | None = None

    def __post_init__(self):
        unknown = set(self.themes or ()) - set(THEMES)
        if unknown:
            raise ValueError(f"unknown themes: {sorted(unknown)}")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def role_filter(roles) -> Column:
    return has_role(*roles)


def rating_floor(min_rating: float, min_reviews: int) -> Column:
    return (F.col("review_rating") >= min_rating) & (F.col("review_count") >= min_reviews)


def _overlaps(themes) -> Column:
    wanted = F.array(*[F.lit(t) for t in themes])
    return F.coalesce(F.arrays_overlap("all_themes", wanted), F.lit(False))


def theme_gate(themes) -> Column:
    """Places to eat and stay always pass; others need one of the themes, if any are given."""
    if not themes:
        return F.lit(True)
    return has_role("accommodation", "meal") | _overlaps(themes)


def theme_exclusion(themes) -> Column:
    if not themes:
        return F.lit(True)
    return ~has_role("attraction") | ~_overlaps(themes)


def dietary_filter(halal=False, vegetarian=False, vegan=False) -> Column:
    """Binds places to eat only; a vegan offer also serves vegetarians."""
    ok = F.lit(True)
    if halal:
        ok = ok & _flag("halal_food")
    if vegetarian:
        ok = ok & (_flag("vegetarian_options") | _flag("vegan_options"))
    if vegan:
        ok = ok & _flag("vegan_options")
    return ~has_role("meal") | ok


def wheelchair_filter(only: bool) -> Column:
    if not only:
        return F.lit(True)
    return (
        _flag("wheelchair_accessible_entrance") | _flag("wheelchair_accessible_seating")
        | _flag("wheelchair_accessible_toilet")
    )


def company_filter(flag: str, only: bool) -> Column:
    """Children or pets: binds attractions and places to eat."""
    return ~has_role("attraction", "meal") | _flag(flag) if only else F.lit(True)


def eligible(want: CandidateFilter) -> Column:
    return (
        rating_floor(want.min_rating, want.min_reviews)
        & role_filter(want.roles)
        & dietary_filter(want.halal_only, want.vegetarian_only, want.vegan_only)
        & wheelchair_filter(want.wheelchair_only)
        & company_filter("kids_friendly", want.kids_friendly_only)
        & company_filter("pets_friendly", want.pets_friendly_only)
        & theme_gate(want.themes) & theme_exclusion(want.excluded_themes)
    )


def like_pattern(text: str) -> str:
    """A LIKE pattern in which a backslash may stand before any character."""
    out, chars = [], iter(text)
    for ch in chars:
        if ch == "\\":
            ch = next(chars, None)
            if ch is None:
                raise ValueError("LIKE pattern must not end with the escape character")
            ch = f"\\{ch}" if ch in "%_\\" else ch
        out.append(ch)
    return "".join(out)


def pick_destination(areas: DataFrame, destination: str | None):
    """The area a destination text names: countries first, then cities, then the lowest id."""
    if destination is None:
        return None
    name = like_pattern(destination.split(",")[0].strip())
    rank = F.when(F.col("kind") == "country", 2).when(F.col("kind") == "city", 1).otherwise(0)
    return areas.filter(F.col("name").ilike(name)).orderBy(rank.desc(), "id").select("id", "kind").first()


def _order() -> list[Column]:
    return [F.col("theme_match").desc(), F.col("quality_score").desc(),
            F.coalesce("distance_m", F.lit(1e9)), F.col("id")]


def role_rows(scored: DataFrame, roles) -> DataFrame:
    """One row per place and requested role it plays."""
    wanted = F.array(*[F.lit(r) for r in dict.fromkeys(roles)])
    return scored.withColumn("role_pick", F.explode(F.array_intersect(wanted, F.col("poi_roles"))))


def cap_per_area(rows: DataFrame, cap: int) -> DataFrame:
    """The best `cap` rows per role and area."""
    return top_per_group(rows, ["role_pick", "area_id"], _order(), cap, "id", out="rn_area")


def rank_ids(rows: DataFrame) -> DataFrame:
    """Number the roles of each place: attraction, then meal, then the other."""
    first = F.when(F.col("role_pick") == "attraction", 1).when(F.col("role_pick") == "meal", 2).otherwise(3)
    return rows.withColumn("rn_id", F.row_number().over(Window.partitionBy("id").orderBy(first)))


def take_quota(rows: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Rank each role over all its rows, then keep those within quota that are their place's
    first role. The quota counts rows of places that end up under another role, so the rank
    must not be taken after that choice. Input is bounded by cap x areas x roles."""
    top = max([0, *quotas.values()])
    ranked = top_per_group(rank_ids(rows), "role_pick", _order(), top, "id", out="rn_role")
    within = F.lit(False)
    for role, quota in quotas.items():
        within = within | ((F.col("role_pick") == role) & (F.col("rn_role") <= quota))
    return ranked.filter((F.col("rn_id") == 1) & within)


def score(pois: DataFrame, themes, seed_lon=None, seed_lat=None) -> DataFrame:
    scored = pois.withColumns({
        "theme_match": scoring.theme_match("poi_roles", "themes", themes),
        "quality_score": scoring.quality_score("review_rating", "review_count"),
    })
    return scored.withColumn("distance_m", geo.distance("longitude", "latitude", seed_lon, seed_lat))


def poi_candidates(pois: DataFrame, areas: DataFrame, edges: DataFrame, theme_map: DataFrame,
                   destination: str | None, quota_attraction: int, quota_meal: int,
                   quota_accommodation: int, want: CandidateFilter = CandidateFilter(),
                   per_area_cap: int = 150, include_images: bool = True,
                   seed_lon=None, seed_lat=None) -> DataFrame:
    """Places for a trip to `destination`, at most the quota per role.

    Filters run before the spatial join, the destination's box first of all, and only the id and the sort keys go through the
    shuffles. The result has at most the sum of the quotas rows, so it is broadcast to fetch
    the wide columns."""
    dest = pick_destination(areas, destination)
    wide = pois.select(
        "id", F.col("poi_roles").alias("roles"),
        *[c if c in pois.columns else F.lit(None).cast("string").alias(c) for c in PAYLOAD],
        media.preview_image("images", include_images if "images" in pois.columns else False).alias("images"),
    )
    if dest is None:
        empty = wide.withColumns({c: F.lit(None).cast("string") for c in ("role_pick", "area_name")})
        empty = empty.withColumn("themes", F.array().cast("array<string>"))
        return empty.withColumn("distance_m", F.lit(None).cast("double")).select(*OUTPUT).filter(F.lit(False))

    cover = areas.filter((F.col("id") == dest["id"]) | (F.col("parent_id") == dest["id"]))
    ids = small_values(cover, "id")
    if ids is not None:
        borders = edges.filter(F.col("area_id").isin(*[i for (i,) in ids]))
    else:
        borders = lookup_join(edges, cover.select(F.col("id").alias("area_id")), "area_id",
                              ["x1", "y1", "x2", "y2"], "left_semi")

    flags = [c for c in PAYLOAD[7:] if c in pois.columns]
    narrow = pois.select("id", "categories", "poi_roles", "review_rating", "review_count",
                         "latitude", "longitude", *flags)
    # Whatever lies outside the destination's box is not read from a table that is laid out by place.
    narrow = in_box(narrow, bounding_box(borders))
    asked = narrow.withColumns({c: F.lit(False) for c in PAYLOAD[7:] if c not in flags})
    able = with_themes(asked, theme_map, out="all_themes").filter(eligible(want))
    able = able.withColumn(
        "themes", F.when(has_role("attraction"), F.col("all_themes")).otherwise(F.array().cast("array<string>"))
    ).select("id", "poi_roles", "themes", "review_rating", "review_count", "latitude", "longitude")

    placed = with_first_area(able, borders, "area_size").filter("area_id IS NOT NULL")
    rows = role_rows(score(placed, want.themes, seed_lon, seed_lat), want.roles).select(
        "id", "area_id", "role_pick", "themes", "theme_match", "quality_score", "distance_m")
    quotas = dict(zip(("attraction", "meal", "accommodation"),
                      (quota_attraction, quota_meal, quota_accommodation)))
    chosen = take_quota(cap_per_area(rows, per_area_cap), quotas)
    chosen = chosen.join(cover.select(F.col("id").alias("area_id"), F.col("name").alias("area_name")), "area_id", "left")
    chosen = chosen.select("id", "themes", "role_pick", "area_name", "distance_m")
    if sum(max(q, 0) for q in quotas.values()) <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    return wide.join(chosen, "id").select(*OUTPUT)
