"""Named values the scores and reports depend on.

Everything in this module is a fixed value of the published scoring rules
(code lists, thresholds, points, message texts).  Operators take most of them
as keyword arguments, with these as defaults.
"""

# --- fixed values: code lists ------------------------------------------------
CATEGORY_CODES = ["AM", "VM", "SM", "PT", "NC", "BN", "LS", "LH", "OM"]
UNKNOWN_CODE = "UNKNOWN"  # prediction side of an evaluation
NONE_CODE = "NONE"  # ground-truth side of an evaluation
BANDS = ["verified", "review", "flag"]
PHOTO_SOURCE_DEFAULT = "field"
PHOTO_SOURCES_SYNTHETIC = ["ai_generated", "stock_cc", "unknown"]
PHOTO_SOURCES_ALL = ["field", "ai_generated", "stock_cc", "unknown"]
CONSTRUCTION_STAGES = ["not_started", "under_construction", "completed", "damaged", "unclear"]
WATER_VISIBLE = ["yes", "no", "unclear"]
VEGETATION_COVER = ["low", "medium", "high", "unclear"]
MATCH_RESULTS = ["yes", "no", "uncertain"]
THEMATIC_LAYERS = ["drainage", "lulc", "ndvi_before", "ndvi_after", "ndvi_change", "water"]
STATUS_SLUGS = ["accepted", "yet_to_moderate", "rejected", "not_submitted", "mixed", "other"]
ORDERED_STAGES = ["not_started", "under_construction", "completed"]

# --- fixed values: geo-integrity rules ---------------------------------------
GPS_GOOD_M = 10.0
GPS_OK_M = 25.0
EXIF_TOLERANCE_M = 100.0
DUPLICATE_MAX_HAMMING = 6
RULE_POINTS = {
    "gps_accuracy": 8,
    "inside_boundary": 8,
    "exif_consistency": 6,
    "duplicate_photo": 5,
    "timestamp_sane": 3,
}
GPS_PARTIAL_POINTS = 4
EXIF_PARTIAL_POINTS = 3
DETAIL = {
    "gps_missing": "gps_accuracy_m missing",
    "inside": "point falls inside mws boundary",
    "outside": "point falls outside mws boundary",
    "exif_none": "no EXIF GPS or timestamp found on photo",
    "exif_both": "EXIF GPS and timestamp both present and consistent with submitted metadata",
    "exif_one_matches": "EXIF GPS and timestamp both present but only one matches submitted metadata",
    "exif_neither": "EXIF GPS and timestamp both present but neither matches submitted metadata",
    "exif_partial": "only one of EXIF GPS/timestamp present on photo (partial credit)",
    "hash_missing": "no photo hash available to compare",
    "hash_unique": "no near-duplicate photo found among stored records",
    "time_missing": "captured_at missing",
    "time_future": "captured_at is in the future",
    "time_ok": "captured_at within project window and not future-dated",
}

# --- fixed values: photo match -----------------------------------------------
CONFIDENCE_HIGH = 0.75
CONFIDENCE_MEDIUM = 0.5
CONFIDENCE_REVIEW = 0.6
VISUAL_POINTS = {"yes_high": 30, "yes_medium": 20, "yes_low": 10, "uncertain": 10, "no": 0}
EMPTY_EVIDENCE_TEXT = "(model did not provide a text justification for this classification)"
INVALID_ACTIVITY_TEXT = "unclassified (invalid classifier response)"
INVALID_EVIDENCE_PREFIX = "Classifier response invalid"
INVALID_REASON_MAX = 400
RESPONSE_KEYS = [
    "predicted_category",
    "predicted_activity",
    "construction_stage",
    "water_visible",
    "vegetation_cover",
    "matches_declared",
    "confidence",
    "evidence",
]

# --- fixed values: satellite response ----------------------------------------
DID_POINTS = {"strongly_positive": 30, "weakly_positive": 18, "inconclusive": 10, "negative": 0}
NO_SIGNAL_POINTS = 15
DID_THRESHOLDS = {  # index: (strong, weak)
    "NDVI": (0.08, 0.02),
    "NDMI": (0.08, 0.02),
    "MNDWI": (0.05, 0.015),
    "water_fraction": (0.15, 0.05),
    "NDVI_NDMI_MEAN": (0.08, 0.02),
}
PRIMARY_INDEX = {
    "PT": "water_fraction",
    "NC": "water_fraction",
    "SM": "water_fraction",
    "VM": "NDVI",
    "AM": "NDVI",
    "BN": "NDVI_NDMI_MEAN",
}
NO_SIGNAL_CATEGORIES = ["LS", "LH", "OM"]
NEGATIVE_NOTE = (
    "Negative DiD relative to control — flagged for review. This can also mean "
    "'too early post-work' rather than failure; not a definitive verdict."
)
NO_SIGNAL_NOTE = (
    "Category %s: satellite evidence is not meaningful for this "
    "activity type — neutral score applied, not computed from data."
)

# --- fixed values: satellite pixels and zones --------------------------------
REFLECTANCE_SCALE = 0.0000275
REFLECTANCE_OFFSET = -0.2
QA_CLOUD_BIT = 3
QA_SHADOW_BIT = 4
TREATED_RADIUS_M = 200.0
CONTROL_INNER_M = 350.0
CONTROL_OUTER_M = 1000.0
MIN_CLEAR_OBS = 3
EARTH_RADIUS_M = 6_371_000.0
M_PER_DEG_LAT = 110_574.0
M_PER_DEG_LON_EQUATOR = 111_320.0
ELEVATION_NODATA_BELOW = -1000.0
CLASS_CROP, CLASS_BUILT, CLASS_WATER, CLASS_TREE = 40, 50, 80, 10

# --- fixed values: candidate ranking and matching ----------------------------
MAX_BUILT_SHARE = 0.15
MAX_WATER_SHARE = 0.30
MIN_AREA_HA = 50.0
MAX_AREA_HA = 8000.0
WEIGHT_CROP, WEIGHT_LOW_BUILT, WEIGHT_LOW_WATER = 0.5, 0.3, 0.2
SLOPE_BAND_DEG = (1.0, 8.0)
CROP_TOLERANCE = 0.15
SLOPE_TOLERANCE_DEG = 3.0
NO_PIXELS_REASON = "no valid land-cover pixels (outside fetched raster coverage)"
SLOPE_NOT_EVALUATED = "not_evaluated_missing_slope"
NDVI_PENDING = "pending"

# --- fixed values: impact estimate -------------------------------------------
BOOTSTRAP_DRAWS = 2000
BOOTSTRAP_CI = 0.95
NOTE_NO_CONTROLS = "No control polygons available — cannot compute a DiD effect."
NOTE_FEW_YEARS = "Insufficient years on one side of project_start_year to compute an effect."
NOTE_NO_DRAWS = "Bootstrap produced no valid resamples (insufficient pre/post year coverage)."

# --- fixed values: registry --------------------------------------------------
ACTIVITY_KEYWORDS = [  # first keyword found in the lower-cased activity wins
    ("farm pond", "PT"),
    ("amrit sarovar", "PT"),
    ("check dam", "SM"),
    ("bunding", "BN"),
    ("bund", "BN"),
    ("irrigation", "NC"),
    ("drainage channel", "NC"),
    ("channel", "NC"),
    ("goatery", "LS"),
    ("piggery", "LS"),
    ("dairy", "LS"),
    ("duckery", "LS"),
    ("bee keeping", "LH"),
    ("weaving", "LH"),
    ("handloom", "LH"),
    ("hand craft", "LH"),
    ("handicraft", "LH"),
    ("horticulture", "LH"),
    ("fisheries", "LH"),
]
DEFAULT_CATEGORY = "OM"
STATUS_WORDS = {
    "accepted": "accepted",
    "rejected": "rejected",
    "yet to moderate": "yet_to_moderate",
}
BLANK_STATUS_DISPLAY = "Not Submitted"

# --- fixed values: evidence score and evaluation -----------------------------
VERIFIED_FROM = 70
REVIEW_FROM = 40
TEMPORAL_SINGLE, TEMPORAL_FULL = 5, 10
OUTCOME_WEIGHTS = (0.5, 0.3, 0.2)
INVALID_SHARE_LIMIT = 0.5
