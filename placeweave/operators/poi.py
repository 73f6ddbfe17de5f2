"""From clean listings to the place table: typed columns, roles and themes of categories."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave import schemas
from placeweave.constants import FLAGS, ROLES, THEMES
from placeweave.functions import text
from placeweave.operators.skew import lookup_join, small_values


def _any_of(categories: Column, words) -> Column:
    return F.coalesce(F.exists(categories, lambda x: x.isin(*words)), F.lit(False))


def _with_labels(pois: DataFrame, pairs: DataFrame, label: str, known, out: str, id_col: str) -> DataFrame:
    """Distinct labels of each row's categories, in the order of `known`. A map that fits
    becomes set literals and the rows are not shuffled; a longer one is joined."""
    rows = small_values(pairs.select("category", label), "category", label)
    c = F.col("categories")
    if rows is not None:
        sets = {k: [cat for cat, lab in rows if lab == k] for k in known}
        found = [F.when(_any_of(c, s), F.lit(k)) for k, s in sets.items() if s]
        labels = F.array_compact(F.array(*found)) if found else F.array()
        return pois.withColumn(out, labels.cast("array<string>"))
    tokens = pois.select(id_col, F.explode(F.array_distinct("categories")).alias("category"))
    hits = (
        lookup_join(tokens, pairs.select("category", label).distinct(), "category", id_col)
        .groupBy(id_col).agg(F.collect_set(label).alias("_labels"))
    )
    order = F.array(*[F.lit(k) for k in known])
    labels = F.coalesce(F.array_intersect(order, F.col("_labels")), F.array().cast("array<string>"))
    return pois.join(hits, id_col, "left").withColumn(out, labels).drop("_labels")


def with_roles(pois: DataFrame, role_map: DataFrame, id_col: str = "id") -> DataFrame:
    """`poi_roles` of the categories; a place to stay that also serves meals is no meal."""
    df = _with_labels(pois, role_map, "role", ROLES, "poi_roles", id_col)
    r = F.col("poi_roles")
    return df.withColumn(
        "poi_roles", F.when(F.array_contains(r, "accommodation"), F.array_remove(r, "meal")).otherwise(r))


def with_themes(pois: DataFrame, theme_map: DataFrame, id_col: str = "id", out: str = "themes") -> DataFrame:
    return _with_labels(pois, theme_map, "theme", THEMES, out, id_col)


def has_role(*roles: str) -> Column:
    """Does `poi_roles` hold any of these?"""
    return F.coalesce(
        F.arrays_overlap("poi_roles", F.array(*[F.lit(r) for r in roles])), F.lit(False)
    ) if roles else F.lit(False)


def point(lon: str = "longitude", lat: str = "latitude") -> Column:
    return F.when(
        F.col(lon).isNotNull() & F.col(lat).isNotNull(),
        F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat")),
    )


def poi_id(link: str = "google_map_link") -> Column:
    """The same link always gives the same id, also when a task is run again."""
    return F.sha2(F.col(link), 256)


def derive_poi(listings: DataFrame, role_map: DataFrame) -> DataFrame:
    """Clean listings to rows of the place table: names and types of the table, false for a
    missing flag, no row without link or name, geometry and roles."""
    df = listings.withColumnRenamed("link", "google_map_link")
    loaders = {
        "categories": text.loader_categories, "open_hours": lambda c: text.loader_json(c, "map<string,array<string>>"),
        "complete_address": lambda c: text.loader_json(c, "map<string,string>"),
    }
    out = []
    for name, kind in schemas.POI_COLUMNS.items():
        if name not in df.columns:
            value = F.lit(None).cast(kind)
        elif name in loaders and df.schema[name].dataType.simpleString() == "string":
            value = loaders[name](name)
        else:
            value = F.col(name).try_cast(kind)
        out.append((F.coalesce(value, F.lit(False)) if name in FLAGS else value).alias(name))
    typed = df.select(*out).filter("google_map_link IS NOT NULL AND name IS NOT NULL")
    typed = typed.withColumn("id", poi_id()).withColumn("point", point())
    return with_roles(typed, role_map)
