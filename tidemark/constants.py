"""Fixed values.

Everything here must equal the published definitions for results to agree.
"""

HEADS = ("reply", "retweet", "like", "deep")

# Published head weights.
WEIGHTS = {"reply": 13.5, "retweet": 1.0, "like": 0.5, "deep": 2.0}

SLOW_HEADS = ("reply", "deep")
FAST_HEADS = ("retweet", "like")

# Sigmoid floor gate.
FLOOR = 1.0
FLOOR_SCALE = 0.5

# Guards.
RATIO_EPS = 1e-6
MULTIPLIER_EPS = 1e-12
GEOMETRIC_EPS = 1e-9
SCALER_FLOOR = 1e-6
SUBSTANCE_FLOOR = 1e-9

# Labels.
LOW = "low_credibility"
HIGH = "high_credibility"
MIXED = "mixed"
HIGH_EMOTION = "high_emotion"
LOW_EMOTION = "low_emotion"

# Exposure model.
BASELINE_EXPOSURES = 200.0
EXPOSURE_MIN = 0.0
EXPOSURE_MAX = 50_000.0
N_TIME_BINS = 24
DECAY_TAU_HOURS = 6.0

# Calibration.
CALIBRATION_TRIM = 0.05
CALIBRATION_MIN_ROWS = 20
DISPERSION_MIN = 0.05
DISPERSION_MAX = 100.0
FACTOR_MIN = 1e-6

# Parameter grids.
FLOOR_GRID = tuple(round(0.1 * i, 1) for i in range(26))
TEMPER_GRID = (0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0)
TAIL_GRID = (0.10, 0.20)
CLOSURE_THRESHOLDS = (50, 80, 100)
COLLATERAL_BUDGET_PCT = 10.0

# Sampling and matching.
SEED = 1337
CONTROLS_PER_CASE = 10
MIN_TEXT_LENGTH = 30
MIN_STRATUM_ROWS = 30
DEMOTED_POINTS = 1.0

# Author age is measured to this day in subgroup cuts.
AGE_REFERENCE_DATE = "2024-06-15"

# Slow/fast partition variants: name -> (slow heads, fast heads).
PARTITIONS = {
    "default": (("reply", "deep"), ("retweet", "like")),
    "quote_as_fast": (("reply",), ("retweet", "like", "deep")),
    "like_as_slow": (("reply", "deep", "like"), ("retweet",)),
    "reply_only_slow": (("reply",), ("retweet", "like")),
}

# Feature names, in matrix order.
CONTINUOUS_FEATURES = (
    "log_followers",
    "log_friends",
    "log_statuses",
    "log_favourites",
    "log_listed",
    "log_clout",
    "log_favs_per_status",
    "log_statuses_per_day",
    "log_account_age_days",
    "log_text_length",
    "hour_sin",
    "hour_cos",
    "weekhour_sin",
    "weekhour_cos",
)
BINARY_FEATURES = ("user_blue", "is_reply", "is_quote", "has_url")
FEATURES = CONTINUOUS_FEATURES + BINARY_FEATURES

FEATURE_SUBSETS = {
    "full": FEATURES,
    "tweet_time_only": (
        "log_text_length",
        "hour_sin",
        "hour_cos",
        "weekhour_sin",
        "weekhour_cos",
        "is_reply",
        "is_quote",
        "has_url",
    ),
    "account_only": (
        "log_followers",
        "log_friends",
        "log_statuses",
        "log_favourites",
        "log_listed",
        "log_clout",
        "log_favs_per_status",
        "log_statuses_per_day",
        "log_account_age_days",
        "user_blue",
    ),
    "minimal_3": ("log_followers", "log_text_length", "has_url"),
}

SUBSTANCE_FEATURES = (
    "log_followers",
    "log_listed",
    "log_clout",
    "log_text_length",
    "user_blue",
)

TARGET_COUNTS = {
    "reply": "replyCount",
    "retweet": "retweetCount",
    "like": "likeCount",
    "deep": "quoteCount",
}

# Author fields kept from the nested author value.
USER_FIELDS = (
    "id_str",
    "username",
    "followersCount",
    "friendsCount",
    "statusesCount",
    "favouritesCount",
    "listedCount",
    "mediaCount",
    "verified",
    "blue",
    "created",
)

# Raw columns read as numbers.
NUMERIC_COLUMNS = (
    "conversationId",
    "in_reply_to_status_id_str",
    "in_reply_to_user_id_str",
    "replyCount",
    "retweetCount",
    "likeCount",
    "quoteCount",
    "epoch",
)

# Raw columns left out of the cleaned table.
DROPPED_COLUMNS = (
    "Unnamed: 0",
    "user",
    "viewCount",
    "links",
    "user_dict",
    "_user_created_raw",
    "_type",
    "type",
    "location",
    "cash_app_handle",
    "url",
    "media",
    "hashtags",
    "mentionedUsers",
    "conversationIdStr",
)

# Columns a seed row keeps.
SEED_COLUMNS = (
    "id_str",
    "rawContent",
    "epoch",
    "replyCount",
    "retweetCount",
    "likeCount",
    "quoteCount",
    "is_reply",
    "is_quote",
    "is_original",
    "link_urls",
    "user_id_str",
    "user_followersCount",
    "user_friendsCount",
    "user_statusesCount",
    "user_favouritesCount",
    "user_listedCount",
    "user_blue",
)

# Default lexicon emotions and token pattern.
EMOTIONS = ("anger", "disgust")
TOKEN_PATTERN = "[a-z']+"
HIGH_EMOTION_QUANTILE = 0.80

# Short public-suffix list; pass a fuller table where one is at hand.
PUBLIC_SUFFIXES = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co",
    "us", "uk", "ca", "au", "nz", "de", "fr", "es", "it", "nl", "be", "ch", "at",
    "se", "no", "dk", "fi", "pl", "ru", "in", "jp", "cn", "kr", "br", "mx", "tv",
    "me", "news", "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au",
    "org.au", "gov.au", "co.nz", "co.jp", "co.in", "co.kr", "com.br", "com.mx",
    "com.cn", "co.za",
    "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck",
)
