"""Table schemas and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Application tables (explicit schemas; ids are data, never auto-generated).
# --------------------------------------------------------------------------
USERS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("username", T.StringType(), True),
        T.StructField("email", T.StringType(), True),
        T.StructField("language_preference", T.StringType(), True),
        T.StructField("role", T.StringType(), True),
    ]
)
PROFILES = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("age_group", T.StringType(), True),
        T.StructField("language_preference", T.StringType(), True),
    ]
)
USER_TEXTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("input_text", T.StringType(), False),
        T.StructField("content_text", T.StringType(), False),
        T.StructField("content_type", T.StringType(), False),
        T.StructField("model_used", T.StringType(), True),
        T.StructField("created_at", T.TimestampNTZType(), True),
    ]
)
USER_FEEDBACK = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("feedback_type", T.StringType(), False),
        T.StructField("comment", T.StringType(), True),
        T.StructField("created_at", T.TimestampNTZType(), True),
    ]
)
LOGIN_HISTORY = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("user_id", T.LongType(), True),
        T.StructField("login_time", T.TimestampNTZType(), True),
    ]
)
DATASET = T.StructType(
    [
        T.StructField("input_text", T.StringType(), True),
        T.StructField("target_text", T.StringType(), True),
        T.StructField("task", T.StringType(), True),
        T.StructField("domain", T.StringType(), True),
    ]
)
EVAL_CSV = T.StructType(
    [
        T.StructField("original", T.StringType(), True),
        T.StructField("reference", T.StringType(), True),
        T.StructField("generated_conservative", T.StringType(), True),
        T.StructField("generated_balanced", T.StringType(), True),
        T.StructField("generated_creative", T.StringType(), True),
    ]
)

TABLE_SCHEMAS = {
    "users": USERS,
    "profiles": PROFILES,
    "user_texts": USER_TEXTS,
    "user_feedback": USER_FEEDBACK,
    "login_history": LOGIN_HISTORY,
}

# --------------------------------------------------------------------------
# FIXED VALUES — must equal the behaviour being reproduced.  Kept together,
# as plain text, in their natural order.
# --------------------------------------------------------------------------

# Paraphrase creativity levels, in report order, and their sampling presets
# (temperature, top_p, repetition_penalty).
LEVELS = ["conservative", "balanced", "creative"]
LEVEL_PRESETS = [
    ("conservative", 0.5, 0.7, 1.3),
    ("balanced", 0.9, 0.92, 1.1),
    ("creative", 1.2, 0.95, 1.0),
]
DEFAULT_LEVEL = "balanced"

# Summary length presets: (name, max_length, min_length, length_penalty, num_beams).
SUMMARY_PRESETS = [
    ("short", 45, 10, 1.0, 3),
    ("medium", 70, 40, 1.5, 5),
    ("long", 100, 80, 2.0, 6),
]
# Paraphrase reading-level presets, same fields.
PARAPHRASE_PRESETS = [
    ("Beginner", 60, 20, 0.8, 3),
    ("Intermediate", 100, 40, 1.2, 4),
    ("Advanced", 140, 80, 1.5, 6),
]
# Defaults of the long-text paths when no preset is given.
DEFAULT_SUMMARY_PARAMS = (100, 80, 2.0, 6)
DEFAULT_PARAPHRASE_PARAMS = (120, 30, 1.2, 4)
# Second (hierarchical) summary pass decode knobs.
SECOND_PASS_TEMPERATURE = 0.3
SECOND_PASS_NO_REPEAT_NGRAM = 4
SECOND_PASS_REPETITION_PENALTY = 2.5

# Routing thresholds (whitespace words / tokens).
SUMMARY_DIRECT_MAX_WORDS_EXCL = 500  # summary goes direct when words < 500
PARAPHRASE_DIRECT_MAX_WORDS = 100  # paraphrase goes direct when words <= 100
CHUNK_TOKENS = 512

# Fixed generation flags added to every paraphrase request.
GEN_DO_SAMPLE = True
GEN_NUM_BEAMS = 1
GEN_CLEAN_UP_TOKENIZATION_SPACES = True
# Request defaults: endpoint (n, max_new_tokens); batch fill job.
REQUEST_DEFAULT_N = 1
REQUEST_DEFAULT_MAX_NEW_TOKENS = 50
REQUEST_DEFAULT_MODEL = "t5"
BATCH_FILL_N = 1
BATCH_FILL_MAX_NEW_TOKENS = 100
REQUEST_MIN_CHARS = 3

# Model aliases (case-insensitive) to repository ids.
MODEL_ALIASES = [
    ("t5", "ramsrigouthamg/t5_paraphraser"),
    ("bart", "eugenesiow/bart-paraphrase"),
]

# Prefixes stripped from generated summaries, in this order, once each.
UNWANTED_PREFIXES = ["conclusion:", "conclusion", "summary:", "summary", "in conclusion"]

# Terms banned from summaries.
BANNED_TERMS = [
    "series", "part", "conclusion", "article", "copyright", "postmedia",
    "http", "www", ".com", "email", "share", "click",
    "including", "such as",
]

# Prompt templates.
PEGASUS_PROMPT = (
    "Summarize the following text clearly and concisely without adding any "
    "external information: "
)
SUMMARY_PROMPT = "Summarize: "
PARAPHRASE_PROMPT = "Paraphrase this academically: "

# Language name -> code.
LANG_CODES = [
    ("English", "en"),
    ("Tamil", "ta"),
    ("Hindi", "hi"),
    ("French", "fr"),
    ("German", "de"),
    ("Spanish", "es"),
]

# Misc display / paging constants.
PREVIEW_CHARS = 1000
PAGE_SIZE = 20
RECENT_LOGINS = 10
DEFAULT_AGE = 18
AGE_MIN, AGE_MAX = 18, 65
TOP_MODEL_FALLBACK = "N/A"
ROLES = ["admin", "user"]
FEEDBACK_TYPES = ["like", "dislike"]
CONTENT_TYPE_MAX_LEN = 20
MODEL_USED_MAX_LEN = 100

# Readability formula constants (published formulas).
FLESCH_BASE, FLESCH_WPS, FLESCH_SPW = 206.835, 1.015, 84.6
FOG_FACTOR = 0.4
SMOG_FACTOR, SMOG_BASE, SMOG_SENTENCES = 1.043, 3.1291, 30
