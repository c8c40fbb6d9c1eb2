"""They decide results, so they are stated once, plainly, in natural order."""

# ---- fixed values: severities and categories -------------------------------
SEVERITY_ORDER = {"noise": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITIES = ["critical", "high", "medium", "low", "noise"]
CATEGORIES = [
    "pricing_change",
    "feature_launch",
    "feature_removal",
    "hiring_signal",
    "messaging_change",
    "partnership",
    "technical_change",
    "other",
]
PAGE_TYPES = ["pricing", "changelog", "homepage", "jobs", "blog", "docs", "other"]

# ---- fixed values: line patterns that are noise on every site ---------------
GLOBAL_NOISE_PATTERNS = [
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?",
    r"\d{10,13}",
    r"[a-f0-9]{8,32}(?=\.(js|css|png|jpg|svg|woff2?))",
    r"bundle\.[a-f0-9]+\.js",
    r"chunk-[a-f0-9]+",
    r"csrf[_-]?token[\"':\s=]+[\"']?[\w-]+",
    r"session[_-]?id[\"':\s=]+[\"']?[\w-]+",
    r"nonce[\"':\s=]+[\"']?[\w-]+",
    r"utm_\w+=[^&\s]+",
    r"fbclid=[^&\s]+",
    r"gclid=[^&\s]+",
    r"ad[-_]?slot",
    r"google[_-]?ad",
    r"doubleclick",
    r"googletag",
    r"©\s*\d{4}",
    r"[Cc]opyright\s+\d{4}",
    r"cookie[-_]?consent",
    r"cookie[-_]?banner",
    r"__cf_bm=",
]
MIN_RESIDUAL_CHARS = 5

# ---- fixed values: pages that are not real content --------------------------
BOT_PAGE_PATTERN = (
    r"(robot|captcha|verify you.re human|access denied|blocked|"
    r"unusual traffic|security check|please enable javascript|"
    r"checking your browser|attention required|are you a human)"
)
BOT_PAGE_MAX_CHARS = 500
JS_PAGE_MIN_CHARS = 100
DROPPED_TAGS = ["script", "style", "noscript", "iframe", "svg", "head", "meta", "link"]

# ---- fixed values: noise learning -------------------------------------------
MIN_SNAPSHOTS_FOR_LEARNING = 10
MIN_SIMILARITY = 0.58
MIN_LITERAL_CHARS = 8
MAX_LINE_CHARS = 280
MAX_DIFF_IDS = 120
MAX_EXAMPLES = 8
MAX_FILTER_EVENTS = 240
LOOKBACK_DAYS = 60
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.78
DECAY_HALF_LIFE_DAYS = 21.0
MIN_DECAY = 0.20
PROTECTED_WORDS = [
    "price", "pricing", "plan", "plans", "tier", "tiers", "free", "enterprise", "starter", "business",
    "premium", "professional", "trial", "discount", "launch", "launched", "announce", "announced",
    "announcement", "deprecate", "deprecated", "deprecation", "remove", "removed", "retire", "retired",
    "release", "released", "introduce", "introduced",
]
PRICE_PATTERN = r"(\$\s?\d|\d+(?:\.\d+)?\s?%|\b(?:usd|eur|gbp|cad|aud)\b)"
ACTION_PATTERN = r"\b(launch(?:ed)?|deprecat(?:e|ed|ion)|remove(?:d)?|announce(?:d|ment)?|release(?:d)?)\b"
BUSINESS_TERMS = ["tier", "plan", "free", "enterprise", "starter", "pro", "business", "premium"]

# ---- fixed values: classification -------------------------------------------
MAX_DIFF_CHARS = 14000
TRUNCATION_MARK = "\n\n[... diff truncated ...]"
TRUNCATION_NOTE = (
    "\n⚠️ Note: This diff was truncated to fit the analysis budget. The full diff may contain additional changes."
)
FAILED_SUMMARY = "Classification failed — manual review required"
UNCERTAIN_SUMMARY = "Classification uncertain — manual review required"
MAX_SUMMARY_CHARS = 1000
COST_PER_PROMPT_TOKEN = 3.0 / 1_000_000
COST_PER_COMPLETION_TOKEN = 15.0 / 1_000_000

# ---- fixed values: suppression ----------------------------------------------
SUPPRESS_HOURS = 24
OSCILLATION_WINDOW = 6
OSCILLATION_MIN_HASHES = 4
OSCILLATION_MIN_FLIPS = 4

# ---- fixed values: clustering -----------------------------------------------
CLUSTER_WINDOW_HOURS = 48
TEMPORAL_HALF_LIFE_HOURS = 4.0
MERGE_THRESHOLD = 0.45
WEIGHT_TEMPORAL = 0.40
WEIGHT_CATEGORY = 0.30
WEIGHT_KEYWORD = 0.30
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does",
    "did", "will", "would", "could", "should", "may", "might", "shall", "can", "to", "of", "in", "for", "on",
    "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below",
    "between", "out", "off", "over", "under", "again", "further", "then", "once", "and", "but", "or", "nor",
    "not", "no", "so", "if", "than", "too", "very", "just", "about", "change", "changed", "changes",
    "detected", "updated", "update", "page", "new", "now", "added", "removed",
]

# ---- fixed values: messages --------------------------------------------------
SEVERITY_EMOJI = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵"}
DEFAULT_EMOJI = "⚪"
SEVERITY_COLOR = {"critical": "#DC2626", "high": "#EA580C", "medium": "#CA8A04", "low": "#2563EB"}
DEFAULT_COLOR = "#6B7280"
DEFAULT_DIGEST_HOUR = 9

# ---- fixed values: schedule, limits, retention -------------------------------
SCRAPE_BATCH_SIZE = 20
RECENT_MINUTES = 30
PAUSE_AFTER_FAILURES = 5
JS_RECHECK_MINUTES = 5
MAX_MONITORS_PER_USER = 50
MAX_PATTERN_CHARS = 500
NESTED_QUANTIFIER_PATTERN = r"\(.+[*+]\).+[*+]"
REQUESTS_PER_MINUTE = 100
SNAPSHOT_DAYS = 90
DIFF_DAYS = 180
ANALYSIS_DAYS = 365
DELETED_MONITOR_DAYS = 30
API_BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
SCRAPE_BUCKETS = [0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0]
MODEL_BUCKETS = [0.5, 1.0, 2.0, 5.0, 10.0, 30.0]
