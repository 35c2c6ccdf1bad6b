"""Patterns, word lists, weights and limits that results depend on."""

# Tokens, sentences, identifiers, numbers.
WORD = r"[A-Za-z0-9][A-Za-z0-9._:/-]*"
SENTENCE_GAP = r"(?<=[.!?])\s+"
IDENTIFIER = r"\b(?:[A-Z]{1,5}-\d{1,4}|[A-Z]\d{1,3}|V\d{1,3}|X\d{1,3}|IR-\d{1,4}|HMX-\d{1,4}|FW-\d\.\d)\b"
EXACT_IDENTIFIER = r"(?i)\b(?:SB-\d{1,4}|IR-\d{1,4}|HMX-\d{1,4}|V\d{1,3}|X\d{1,3}|FW-\d\.\d)\b"
NUMBER = r"\b\d+(?:\.\d+)?\b"
AFTER_DATE = r"(?i)after (january|february|march|april|may|june|july|august|september|october|november|december) (\d{4})"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# Text that tries to instruct the reader, and characters that betray bad recognition.
INJECTION = (r"(?i)ignore (?:all|any|the)? ?previous instructions", r"(?i)\bsystem\s*:", r"(?i)\breveal\b.*\binternal\b", r"(?i)\bexfiltrate\b")
WEIRD = "�□¤"

# Trust, quality and quarantine.
TRUST_PER_HIT, TRUST_UPPER_TITLE, UPPER_TITLE_OVER = 0.35, 0.05, 10
QUALITY_NO_TITLE, QUALITY_SHORT, SHORT_UNDER, QUALITY_WEIRD_MOST, WEIRD_FACTOR, QUALITY_OCR, OCR_UNDER = 0.15, 0.20, 80, 0.30, 5.0, 0.35, 0.75
LEAST_QUALITY, LEAST_TRUST = 0.45, 0.40

# What each role may see.
ROLE_DISCLOSURES = {
    "external": ("public",),
    "distributor_support": ("public", "partner_shareable"),
    "field_support": ("public", "partner_shareable", "internal"),
    "engineering": ("public", "partner_shareable", "internal"),
    "compliance": ("public", "partner_shareable", "internal", "restricted"),
}

# Near-duplicates.
STOPWORDS = ("the", "and", "for", "with", "this", "that")
NEAR_DUPLICATE = 0.92

# Chunking, indexes, retrieval.
CHUNK_TOKENS, CHUNK_OVERLAP, LINES_PER = 120, 24, 24
K1, B = 1.4, 0.75
DIMS, TABLES, BITS, PROBE, PLANE_SEED = 192, 4, 10, 2, 7
TOP_K, TOP_M, BUDGET, RRF = 8, 5, 420, 60
RERANK = {"identifier": 1.2, "product": 0.4, "region": 0.3, "approved": 0.25, "superseded": -0.35, "quality": -0.20, "trust": -0.20, "overlap": 0.03, "repeat": -0.15}
SUPPORT_OVERLAP, SUPPORT_NUMBERS, SUPPORTED = 0.7, 0.3, 0.55
MAX_STEPS, RETRY_UNDER = 6, 0.02
#: Steps along references from a hit.
FOLLOW_HOPS = 3

# What queries mean. Later task rules win over earlier ones; the first region and product found count.
TASKS = (
    ("comparison", ("compare", "difference", "what changed", "changed after")),
    ("procedural", ("where is", "documented", "procedure", "steps", "rollback")),
    ("structured", ("service center", "service centres", "structured", "which eu service centers")),
    ("multi_hop", ("which supplier", "failure mode", "why ")),
)
REGIONS = (("eu", "EU"), ("europe", "EU"), ("poland", "Poland"), ("north america", "North America"), ("na", "North America"), ("global", "global"))
MODEL_WORDS = ("r-12", "x12", "v14")
PRODUCTS = (("v14", "V14"), ("x12", "X12"), ("phoenix", "Phoenix"))
EXPANSIONS = (
    ("tightening requirements", ("installation torque",)),
    ("rollback", ("credential recovery", "rollback steps", "runbook")),
    ("seal bulletin", ("SB-82", "elastomer revision")),
    ("new seal bulletin", ("SB-82", "coastal maintenance bulletin")),
    ("coastal units", ("coastal maintenance", "saline deployments")),
    ("latest", ("current", "effective now")),
)
AMBIGUOUS = (("phoenix", ("Phoenix product line", "Phoenix migration project", "Phoenix field office")),)
SCOPE_WORDS = ("warranty", "policy", "travel approval", "travel threshold")
SHAREABLE_WORDS, INTERNAL_WORDS = ("customer-shareable", "customer shareable", "public-only"), ("internal", "incident report")
POLICY_FAMILIES = ("EU distributor policy", "North American distributor policy", "internal reseller terms")
FACTS = {"what does gpu stand for": "GPU stands for graphics processing unit.", "what is rag": "RAG stands for retrieval-augmented generation."}

# Sentences that answers consist of besides their evidence.
NO_EVIDENCE, NO_MATERIAL = "I could not find supporting material in the current snapshot.", "No supporting material found."
ASK_SCOPE = "More scope is required before answering reliably: "
TENSION = " The evidence set includes version tension that the answer keeps visible."
CONFLICT, CONFLICT_NOTE = "Active and superseded sources appear together: active=%s, superseded=%s", "Conflict note: "
MANY_CONFLICTS = "Multiple conflicting sources remain unresolved; a human review may be appropriate."
LEAD, COMPARISON_LEAD = "Grounded answer for: ", "Grounded comparison for: "
NEWEST, OLDER, SOURCES = "Newest evidence: ", "Older baseline: ", "Primary sources: "
LOW_SUPPORT = "support below threshold"
CENTERS_FOUND, STEPS_FOUND = "Structured lookup found service centers: %s. ", " Tool lookup found current %s steps: %s."
