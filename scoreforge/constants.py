"""Fixed values.

Everything in this module is a constant that must stay equal to the values
the scoring model was specified with (category lists, weights, templates,
thresholds) or to a public list (Spark's English stop words).  Keep them as
plain text in their natural order; operators take them as default arguments.
"""

# ---- fixed values: categorical domains of a case --------------------------
RISK_CATEGORIES = ["Low", "Medium", "High", "Critical"]
REGULATORY_STATUSES = ["Compliant", "Under Review", "Minor Issues", "Major Issues", "Non-Compliant"]
COMPLIANCE_LEVELS = ["Excellent", "Good", "Fair", "Poor", "Critical"]

# ---- fixed values: category weights of the composite score ----------------
COMPLIANCE_WEIGHT = {"Excellent": 1.0, "Good": 0.8, "Fair": 0.6, "Poor": 0.3, "Critical": 0.1}
RISK_WEIGHT = {"Low": 1.0, "Medium": 0.7, "High": 0.4, "Critical": 0.1}
REGULATORY_WEIGHT = {
    "Compliant": 1.0,
    "Under Review": 0.7,
    "Minor Issues": 0.5,
    "Major Issues": 0.2,
    "Non-Compliant": 0.0,
}

# ---- fixed values: composite score spec ------------------------------------
# (group, group weight, column, transform, scale, term weight)
# transform "ratio": x / scale; "inverse": 1 - x / scale; "map": lookup table.
SCORE_SPEC = [
    ("financial", 0.40, "credit_score", "ratio", 850.0, 0.30),
    ("financial", 0.40, "debt_to_equity_ratio", "inverse", 3.0, 0.25),
    ("financial", 0.40, "liquidity_ratio", "ratio", 3.0, 0.20),
    ("financial", 0.40, "profitability_margin", "ratio", 0.3, 0.25),
    ("operational", 0.25, "operational_efficiency", "ratio", 100.0, 0.40),
    ("operational", 0.25, "customer_satisfaction", "ratio", 100.0, 0.30),
    ("operational", 0.25, "growth_rate", "ratio", 0.5, 0.30),
    ("compliance", 0.25, "compliance_level", "map:compliance", None, 0.40),
    ("compliance", 0.25, "risk_category", "map:risk", None, 0.30),
    ("compliance", 0.25, "regulatory_status", "map:regulatory", None, 0.20),
    ("compliance", 0.25, "regulatory_violations", "inverse", 10.0, 0.10),
    ("market", 0.10, "market_share", "ratio", 0.5, 0.40),
    ("market", 0.10, "years_in_business", "ratio", 50.0, 0.30),
    ("market", 0.10, "audit_score", "ratio", 100.0, 0.30),
]
SCORE_MAPS = {"compliance": COMPLIANCE_WEIGHT, "risk": RISK_WEIGHT, "regulatory": REGULATORY_WEIGHT}

# ---- fixed values: description text ---------------------------------------
COMPLIANCE_WORDS = {"Excellent": "excellent", "Good": "strong", "Fair": "adequate",
                    "Poor": "weak", "Critical": "concerning"}
COMPLIANCE_WORD_DEFAULT = "standard"
# (lower bound, strict) -> candidate words; the last entry is the fallback.
PERFORMANCE_WORDS = [
    (0.15, ["outstanding", "excellent", "strong"]),
    (0.08, ["solid", "good", "stable"]),
    (None, ["moderate", "declining", "challenging"]),
]
DESCRIPTION_TEMPLATES = [
    "A %s company operating in %s with %s regulatory compliance and %s financial performance.",
    "Leading %s organization based in %s showing %s growth trajectory and maintaining %s compliance standards.",
    "Established %s business in %s market with %s operational metrics and %s regulatory standing.",
]
# argument order per template: business, region, then the two words in this order
DESCRIPTION_ARGS = [
    ("compliance", "performance"),
    ("performance", "compliance"),
    ("performance", "compliance"),
]

# ---- fixed values: score tiers ---------------------------------------------
TIERS = [(0.7, "High"), (0.4, "Medium")]
TIER_DEFAULT = "Low"

# ---- fixed values: request defaults ----------------------------------------
SINGLE_REQUEST_ID = "api_request"
BATCH_ID_PREFIX = "batch_"
UNKNOWN_CATEGORY = "Unknown"
UNKNOWN_INSTANCE = "unknown"

# ---- fixed values: request latency histogram bounds (seconds) --------------
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]

# ---- fixed values: Spark's default English stop words (181 words) ----------
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers",
    "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any", "both",
    "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd",
    "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's",
    "it's", "we're", "they're", "i've", "we've", "you've", "they've", "isn't", "aren't",
    "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't",
    "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't",
    "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's",
    "what's", "when's", "where's", "who's", "why's", "would",
]
