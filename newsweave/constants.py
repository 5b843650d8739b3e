"""Fixed values.

Every value in this module is part of the observable behaviour (word lists,
thresholds, lookup tables, patterns, formats).  They are data, not logic, and
are kept together so that they can be reviewed in one place.
"""

# --- fixed values: text -------------------------------------------------------
STOP_WORDS = (
    "a an the and or but of to in on for from with by as at is are was were be been this that it its "
    "their they have has had will would can could about what how why when which who company said says "
    "news report reported latest please tell me does did us"
).split()

# Unicode white space as understood by ECMAScript `\s`, usable in Java and RE2 character classes.
WS_CLASS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WORD_RUN = r"[\p{L}\p{M}\p{N}]+"

# First script present wins, in this order.  The last two scripts are shared by
# two languages each: the caller's language is kept when it is the second one.
SCRIPT_LANGUAGES = (
    (r"[\x{0B80}-\x{0BFF}]", "ta", None),
    (r"[\x{0C80}-\x{0CFF}]", "kn", None),
    (r"[\x{0C00}-\x{0C7F}]", "te", None),
    (r"[\x{0D00}-\x{0D7F}]", "ml", None),
    (r"[\x{0A80}-\x{0AFF}]", "gu", None),
    (r"[\x{0A00}-\x{0A7F}]", "pa", None),
    (r"[\x{0B00}-\x{0B7F}]", "or", None),
    (r"[\x{0980}-\x{09FF}]", "bn", "as"),
    (r"[\x{0900}-\x{097F}]", "hi", "mr"),
)

# --- fixed values: event, tone and failure rules (first match wins) -------------
EVENT_RULES = (
    ("Workforce", r"\b(layoffs?|job cuts?|hiring|employees?|workforce)\b|பணிநீக்கம்|வேலைவாய்ப்பு|ஊழியர்"),
    ("Regulatory", r"\b(regulator|investigation|lawsuit|court|penalty|fined|probe)\b|விசாரணை|அபராதம்"),
    ("Financial results", r"\b(profit|revenue|earnings|quarterly|losses)\b|லாபம்|வருவாய்|நஷ்டம்"),
    ("Funding & deals", r"\b(funding|acquisition|acquires|merger|investment|raises)\b|முதலீடு"),
    ("Product & expansion",
     r"\b(launch|launches|expansion|opens|product|facility|factory)\b|அறிமுகம்|விரிவாக்கம்|தொழிற்சாலை"),
    ("Partnership", r"\b(partner|partnership|agreement|collaborat\w+)\b|ஒப்பந்தம்|கூட்டணி"),
    ("Leadership", r"\b(ceo|appoints|resigns|leadership|chairman)\b|நியமனம்"),
)
DEFAULT_EVENT = "Company update"
POSITIVE_TONE = (
    r"\b(record profit|profit rises|profit grows|revenue grows|revenue rises|wins contract|raises funding)\b"
    r"|லாபம் உயர்வு"
)
NEGATIVE_TONE = (
    r"\b(layoffs?|job cuts?|recall|fined|data breach|profit falls|revenue falls|loss widens)\b"
    r"|பணிநீக்கம்|அபராதம்|நஷ்டம்"
)
NEGATED_TONE = (
    r"\b(no|not|denies|denied|avoids|avoided|without)\b[^\n\r\x{2028}\x{2029}]{0,35}"
    r"\b(layoffs?|job cuts?|recall|fined|data breach|loss)\b"
)
TONES = ("positive", "negative", "mixed", "unclear")
BASELINE_CLAIM = "Passage from the source; independently unverified."
BASELINE_UNCERTAINTY = (
    "Keyword baseline only. Tone is provisional; stakeholder impacts and factual verification require "
    "review. Available text may be an excerpt."
)

FAILURE_RULES = (
    ("Publisher policy", r"robots"),
    ("Access restricted", r"403|401|verification|subscription"),
    ("Rate limited", r"429"),
    ("Feed unavailable", r"404|410|RSS|Atom|advertised|redirect"),
    ("Timeout", r"timeout|timed out|aborted"),
    ("DNS verification", r"DNS|hostname|resolve|public addresses"),
)
DEFAULT_FAILURE = "Retrieval failed"
FAILURE_ACTIONS = {
    "Publisher policy": "Automated access is disallowed. Use a permitted feed or an excerpt you can access.",
    "Access restricted": "Publisher access controls prevented collection. Import an accessible excerpt or use an approved API.",
    "Rate limited": "Retry later; repeated checks may prolong the limit.",
    "Feed unavailable": "Check the publisher’s current RSS directory or replace the source URL.",
    "Timeout": "A later scheduled run will retry this source.",
    "DNS verification": "The hostname could not be safely resolved. Verify the publisher URL.",
    "Retrieval failed": "Inspect the source error and try a permitted feed or article URL.",
}

# --- fixed values: HTML ---------------------------------------------------------
NAMED_ENTITIES = (
    ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("rsquo", "’"), ("lsquo", "‘"),
    ("rdquo", "”"), ("ldquo", "“"), ("ndash", "–"), ("mdash", "—"), ("amp", "&"),
)
DROPPED_BLOCKS = ("script", "style", "noscript", "nav", "footer", "header")
META_DATE_KEYS = ("article:published_time", "datePublished", "pubdate")
UNTITLED = "Untitled article"
BOT_WALL = r"(?i)enable javascript|verify you are human|just a moment"
FEED_MIME = r"(?i)application/(rss|atom)\+xml"
FEED_HREF = r"(?i)(?:rss|feeds?)(?:[/.?]|$)|\.xml(?:\?|$)"
FEED_EXCLUDED = r"(?i)comments?"

# --- fixed values: URL and address rules ------------------------------------------
TRACKING_PARAM = r"(?i)^(utm_|fbclid$|gclid$|mc_cid$|mc_eid$)"
LOCAL_SUFFIX = r"(^|\.)(localhost|local|internal|test|invalid|onion|home|lan)$"
REBINDING_HOST = r"(^|\.)(metadata\.google\.internal|localtest\.me|nip\.io|sslip\.io)$"
PUBLISHER_PREFIX = r"^(www|feeds?|rss)\."
# One publisher serves feeds from one domain and articles from two others.
ALIAS_DOMAINS = (("bbci.co.uk", "bbc.com"), ("bbci.co.uk", "bbc.co.uk"))
# Special-use IPv4 ranges as (first, last) dotted addresses, both inclusive.
SPECIAL_IPV4 = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.88.99.0", "192.88.99.255"),
    ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "255.255.255.255"),
)

# --- fixed values: regions ----------------------------------------------------------
ZONE_REGIONS = (
    ("North", ("Delhi", "Haryana", "Punjab", "Chandigarh", "Himachal Pradesh", "Jammu and Kashmir", "Ladakh",
               "Uttar Pradesh", "Uttarakhand", "Rajasthan")),
    ("South", ("Tamil Nadu", "Karnataka", "Kerala", "Andhra Pradesh", "Telangana", "Puducherry", "Lakshadweep",
               "Andaman and Nicobar Islands")),
    ("East", ("Bihar", "Jharkhand", "Odisha", "West Bengal")),
    ("West", ("Gujarat", "Maharashtra", "Goa", "Dadra and Nagar Haveli and Daman and Diu")),
    ("Central", ("Madhya Pradesh", "Chhattisgarh")),
    ("North East", ("North East", "Assam", "Arunachal Pradesh", "Manipur", "Meghalaya", "Mizoram", "Nagaland",
                    "Sikkim", "Tripura")),
    ("Global", ("Global",)),
)
REGIONS = (
    "India", "Tamil Nadu", "Karnataka", "Kerala", "Andhra Pradesh", "Telangana", "Puducherry", "Delhi",
    "Haryana", "Punjab", "Chandigarh", "Himachal Pradesh", "Jammu and Kashmir", "Ladakh", "Uttar Pradesh",
    "Uttarakhand", "Rajasthan", "Gujarat", "Maharashtra", "Goa", "Madhya Pradesh", "Chhattisgarh", "Bihar",
    "Jharkhand", "Odisha", "West Bengal", "Assam", "Arunachal Pradesh", "Manipur", "Meghalaya", "Mizoram",
    "Nagaland", "Sikkim", "Tripura", "North East", "Andaman and Nicobar Islands", "Lakshadweep",
    "Dadra and Nagar Haveli and Daman and Diu", "Global",
)
DEFAULT_ZONE = "National"
ZONES = ("National", "North", "South", "East", "West", "Central", "North East", "Global")

# --- fixed values: limits and thresholds ------------------------------------------------
MIN_PAGE_CHARS = 80
MIN_SCAN_CHARS = 40
MIN_SENTENCE_CHARS = 35
QUOTE_MIN_CHARS = 12
MAX_URL_CHARS = 2_000
TITLE_JACCARD = 0.72
TEXT_JACCARD = 0.45
STORY_DAYS = 3
BM25_K1 = 1.5
BM25_B = 0.75
DENSE_CUTOFF = 0.28
RRF_K = 60
EVIDENCE_K = 5
COLLECTION_HOURS = 3
DELAYED_HOURS = 6
RUN_INSERT_CAP = 80
SNAPSHOTS_KEPT = 56
RANGE_MAX_DAYS = 90
TILE_DAYS = 7
INDEX_RESULT_CAP = 250
RUN_HISTORY = 150
PAGE_SIZE = 12
ENRICH_MAX_FAILURES = 3
MIN_ALIAS_CHARS = 2
FUTURE_SKEW_SECONDS = 60

# --- fixed values: answers -------------------------------------------------------
EXTRACTIVE_ANSWER = "Relevant source excerpts are listed below. These are retrieval results, not a synthesized or verified answer."
EXTRACTIVE_WARNING = "AI answer validation or generation failed; supporting excerpts are shown instead."
