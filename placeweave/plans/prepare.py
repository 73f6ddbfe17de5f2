"""From raw listings to the linked place table."""

from pyspark.sql import DataFrame

from placeweave.operators import areas as A
from placeweave.operators import clean, dedup, poi
from placeweave.operators.skew import cut_lineage


def prepare_places(feeds, removal_patterns: DataFrame, excluded: DataFrame, guide: DataFrame | None,
                   role_map: DataFrame, admin_areas: DataFrame, edges: DataFrame,
                   persist: bool = True) -> DataFrame:
    """Deduplicate by title and brand, prune, clean, enrich, derive and link. The feeds are
    written out once they are parsed, since CSV with line breaks inside fields cannot be split
    and every later step would read it again, and so are the pruned listings."""
    if persist:
        feeds = [cut_lineage(dedup.union_feeds(*feeds))]
    listings = dedup.dedup_titles(*feeds)
    listings = dedup.dedup_brand_country(listings)
    listings = dedup.prune_by_patterns(listings, removal_patterns)
    if persist:
        listings = cut_lineage(listings)
    cleaned = clean.clean_listings(listings, excluded)
    if guide is not None:
        cleaned = clean.enrich_from_guide(cleaned, guide)
    return A.link_poi_areas(poi.derive_poi(cleaned, role_map), admin_areas, edges)
