"""Fixed values. They have to equal the published ones for results to agree."""

ROLES = ("meal", "accommodation", "attraction")

# Declaration order is the sort order wherever theme arrays are shown.
THEMES = (
    "religious_sites", "adventure", "art_museums", "family", "nature",
    "nightlife", "relax", "shopping", "cultural_history", "food_culinary",
)

# Buckets a label can be sorted into, besides "unique" and "exclude".
BUCKETS = (
    "meal", "accommodation",
    "attractions/food_culinary", "attractions/adventure", "attractions/art_museums",
    "attractions/family", "attractions/cultural_history", "attractions/nature",
    "attractions/nightlife", "attractions/relax", "attractions/religious_sites",
    "attractions/shopping",
)

COUNTRY_NAMES = {"SG": "Singapore", "MY": "Malaysia"}

BRAND_EXEMPTIONS = (
    "restoran al", "swiss", "universal studios", "jade", "yishun town",
    "pasar malam taman", "pasar malam jalan",
)
BRAND_MIN_LENGTH = 10

STREET_VIEW_TITLES = ("street view", "360", "streetview")

ABOUT_SECTIONS_REMOVED = (
    "Atmosphere", "Amenities", "Dining options", "From the business",
    "Getting here", "Offerings", "Parking", "Payments", "Pets",
    "Popular for", "Recycling", "Service options",
)

SCRAPER_COLUMNS_DROPPED = (
    "input_id", "popular_times", "videos", "reviews_per_rating", "cid", "status",
    "reviews_link", "thumbnail", "data_id", "reservations", "order_online", "menu",
    "owner", "user_reviews", "user_reviews_extended", "emails",
)

FLAG_OPTIONS = {
    "kids_friendly": ("Good for kids",),
    "pets_friendly": ("Dogs allowed", "Dogs allowed inside", "Dogs allowed outside"),
    "wheelchair_rental": ("Wheelchair rental",),
    "wheelchair_accessible_car_park": ("Wheelchair-accessible car park",),
    "wheelchair_accessible_entrance": ("Wheelchair-accessible entrance",),
    "wheelchair_accessible_seating": ("Wheelchair-accessible seating",),
    "wheelchair_accessible_toilet": ("Wheelchair-accessible toilet",),
    "halal_food": ("Halal food",),
    "vegan_options": ("Vegan options",),
    "vegetarian_options": ("Vegetarian options",),
    "reservations_required": ("Reservations required",),
}
FLAGS = tuple(FLAG_OPTIONS)

FLAG_CATEGORIES = {
    "halal_food": ("halal restaurant",),
    "vegetarian_options": ("vegetarian restaurant", "vegetarian cafe and deli"),
    "vegan_options": ("vegan restaurant",),
    "pets_friendly": ("cat cafe", "dog cafe"),
}

EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
USERNAME_PATTERN = r"^[a-z0-9_]{3,30}$"

SIMILARITY_THRESHOLD = 0.3

# Terms that keep a label out of every theme list, and the extra ones of "shopping".
BLOCK_TERMS = (
    r"\bwholesale\b", r"\bindustrial\b", r"\brepair\b",
    r"\bservice\s*center\b", r"\bservicing\b", r"\bworkshop\b",
)
SHOPPING_BLOCK_TERMS = (
    r"\bsupply\b", r"\bsupplies\b", r"\bspare\b", r"\bauto\s*part(s)?\b", r"\bhardware\b",
    r"\belectronic(s)?\s*(shop|store)\b", r"\bpharmacy\b", r"\bconvenience\s*store\b",
    r"\bsupermarket\b", r"\bwet\s*market\b", r"\bhypermarket\b", r"\bgeneral\s+store\b",
    r"\bwedding\b", r"\bdepartment\s+store\b", r"\bstate\s+liquor\b", r"\bbaby\b",
    r"\bchildren\b", r"\byouth\s+clothing\b", r"\bsport(ing)?\s+goods\b",
    r"\bsportswear\b", r"\btextile\s+merchant\b",
)
# theme -> (buckets a label must be in, extra block terms)
THEME_POLICY = {
    "shopping": (("attractions/shopping",), SHOPPING_BLOCK_TERMS),
    "food_tour": (("meal", "attractions/food_culinary"), ()),
    "culture": (("attractions/cultural_history", "attractions/religious_sites"), ()),
    "nature": (("attractions/nature",), ()),
    "adventure": (("attractions/adventure",), ()),
    "nightlife": (("attractions/nightlife",), ()),
    "relax": (("attractions/relax",), ()),
    "family": (("attractions/family",), ()),
    "stay": (("accommodation",), ()),
}
