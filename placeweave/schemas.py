"""Explicit schemas; nothing in the package infers one."""

from pyspark.sql import types as T

from placeweave.constants import FLAGS

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
SCORE = T.DecimalType(2, 1)


def _struct(**fields):
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


RAW_LISTING = _struct(
    title=_S, link=_S, categories=_S, address=_S, complete_address=_S, website=_S,
    phone=_S, review_count=_I, review_rating=_D, latitude=_D, longitude=_D,
    price_range=_S, images=_S, about=_S, open_hours=_S, timezone=_S, descriptions=_S,
)

POI_COLUMNS = {
    "google_map_link": _S, "name": _S, "categories": T.ArrayType(_S), "address": _S,
    "timezone": _S, "open_hours": _S, "website": _S, "phone": _S, "review_count": _I,
    "review_rating": SCORE, "latitude": _D, "longitude": _D, "descriptions": _S,
    "price_level": SCORE, "images": T.ArrayType(_S), "complete_address": _S,
    **{flag: _B for flag in FLAGS},
}

PAIR_ROLE = _struct(category=_S, role=_S)
PAIR_THEME = _struct(theme=_S, category=_S)
ASSIGNMENT = _struct(label=_S, buckets=T.ArrayType(_S))

ABOUT = "array<struct<id:string,name:string,options:array<struct<name:string,enabled:boolean>>>>"
IMAGES = "array<struct<title:string,image:string>>"
REPLY = "struct<results:array<struct<label:string,buckets:array<string>>>>"

FEATURE = _struct(
    type=_S, properties=_struct(name=_S, country_iso2=_S, kind=_S, admin_level=_I, parent_id=_S), geometry=_S)
