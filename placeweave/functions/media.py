"""Image lists and the `about` sections of a listing, both JSON text on arrival."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave import schemas
from placeweave.constants import ABOUT_SECTIONS_REMOVED, FLAG_CATEGORIES, FLAG_OPTIONS, STREET_VIEW_TITLES


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any_contains(text: Column, needles) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def image_urls(images) -> Column:
    """URLs of the photos that are not street views, cut at the size suffix. Accepts a list
    of {title, image} objects or a list of URLs; text that is neither gives null."""
    c = _col(images)
    objects = F.from_json(c, schemas.IMAGES)
    kept = F.filter(
        objects,
        lambda i: ~_any_contains(F.lower(F.coalesce(i["title"], F.lit(""))), STREET_VIEW_TITLES)
        & ~F.lower(F.coalesce(i["image"], F.lit(""))).contains("streetview")
        & i["image"].isNotNull(),
    )
    urls = F.filter(
        F.from_json(c, "array<string>"),
        lambda u: u.isNotNull() & ~F.lower(u).contains("streetview"),
    )
    links = F.when(objects.isNotNull(), F.transform(kept, lambda i: i["image"])).otherwise(urls)
    return F.transform(links, lambda u: F.substring_index(u, "=w", 1))


def merge_images(first, then) -> Column:
    return F.concat(F.coalesce(_col(first), _no_strings()), F.coalesce(_col(then), _no_strings()))


def preview_image(images, include: bool = True) -> Column:
    """The first image as a list of one, or an empty list."""
    if not include:
        return _no_strings()
    first = F.get(_col(images), F.lit(0))
    return F.when(first.isNotNull(), F.array(first)).otherwise(_no_strings())


def about_sections(about) -> Column:
    return F.from_json(_col(about), schemas.ABOUT)


def enabled_options(sections) -> Column:
    """Lower-cased names of the enabled options over all sections."""
    per_section = F.transform(
        sections,
        lambda s: F.transform(
            F.filter(s["options"], lambda o: F.coalesce(o["enabled"], F.lit(False))),
            lambda o: F.lower(F.coalesce(o["name"], F.lit(""))),
        ),
    )
    return F.flatten(F.filter(per_section, lambda names: names.isNotNull()))


def option_flag(options: Column, keywords) -> Column:
    words = [k.lower() for k in keywords]
    return F.coalesce(F.exists(options, lambda name: _any_contains(name, words)), F.lit(False))


def category_flag(categories, targets) -> Column:
    wanted = F.array(*[F.lit(t) for t in targets])
    return F.coalesce(F.arrays_overlap(_col(categories), wanted), F.lit(False))


def listing_flags(options: Column, categories) -> dict[str, Column]:
    """All flags of a listing; `options` is the output of `enabled_options`, parsed once."""
    flags = {}
    for name, keywords in FLAG_OPTIONS.items():
        flag = option_flag(options, keywords)
        if name in FLAG_CATEGORIES:
            flag = flag | category_flag(categories, FLAG_CATEGORIES[name])
        flags[name] = flag
    return flags


def keep_sections(sections: Column, removed=ABOUT_SECTIONS_REMOVED) -> Column:
    return F.filter(sections, lambda s: ~F.coalesce(s["name"].isin(*removed), F.lit(False)))
