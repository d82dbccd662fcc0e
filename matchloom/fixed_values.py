"""Fixed values.

Every name below is a value that results depend on: vocabularies, weights,
thresholds and formats.  They are data, kept together and in their natural
order, and every operator that uses one also accepts a replacement for it.
"""

# ---------------------------------------------------------------- fixed values
# Role families in declaration order; ties between families break on this order.
FAMILIES = [
    "backend", "frontend", "fullstack", "mobile", "ml_engineer", "data_engineer",
    "data_analyst", "data_scientist", "devops_sre", "qa", "engineering_manager",
    "non_engineering",
]
DEFAULT_FAMILY = "non_engineering"
MANAGER_FAMILY = "engineering_manager"

# Levels and their order; manager sits beside staff+.
LEVEL_ORDER = {"intern": 0, "junior": 1, "mid": 2, "senior": 3, "staff+": 4, "manager": 4}

SIGNALS_VERSION = "1.0.0"

# Words that state a level and are peeled off the front of a title.
LEVEL_PREFIXES = [
    "senior", "sr", "sr.", "junior", "jr", "jr.", "lead", "principal", "staff",
    "associate", "assistant", "chief", "head", "deputy", "trainee", "intern",
    "graduate", "entry", "level", "i", "ii", "iii", "iv",
]
# Level marks peeled off the end of a title.
LEVEL_SUFFIXES = ["i", "ii", "iii", "iv", "1", "2", "3", "4"]

LEGAL_SUFFIXES = [
    "pvt", "private", "ltd", "limited", "inc", "incorporated", "llp", "llc", "corp",
    "corporation", "co", "gmbh", "technologies", "technology", "labs", "solutions",
    "systems", "services", "india",
]

# Family adjacency: symmetric pairs, identity and default, and the manager rule.
ADJACENCY_IDENTITY = 1.0
ADJACENCY_DEFAULT = 0.0
ADJACENCY_MANAGER_PRIOR = 0.5
ADJACENCY_PAIRS = [
    ("ml_engineer", "data_scientist", 0.70),
    ("ml_engineer", "data_engineer", 0.40),
    ("ml_engineer", "backend", 0.30),
    ("data_scientist", "data_analyst", 0.50),
    ("data_scientist", "data_engineer", 0.35),
    ("data_engineer", "data_analyst", 0.40),
    ("data_engineer", "backend", 0.35),
    ("data_engineer", "devops_sre", 0.30),
    ("backend", "fullstack", 0.70),
    ("frontend", "fullstack", 0.70),
    ("backend", "frontend", 0.20),
    ("backend", "devops_sre", 0.40),
    ("backend", "mobile", 0.20),
    ("mobile", "frontend", 0.35),
    ("mobile", "fullstack", 0.30),
    ("devops_sre", "qa", 0.20),
    ("qa", "backend", 0.20),
    ("qa", "frontend", 0.20),
    ("data_analyst", "non_engineering", 0.15),
]

# Component weights; they sum to 100.
WEIGHTS = {
    "role_match": 30, "skill_overlap": 25, "seniority_fit": 15,
    "evidence_of_shipping": 12, "location_fit": 8, "switch_intent": 5,
    "tenure_stability": 5,
}
MUST_POINTS = 18
GOOD_POINTS = 7
CLAIMED_ONLY_CREDIT = 0.30
BAND_IN = 15
BAND_NEAR = 9
BAND_NEAR_YEARS = 1.0
BAND_DECAY_YEARS = 3.0
LOCATION_POINTS = {"exact": 8, "remote": 8, "metro": 5, "other": 2}
TENURE_FACTORS = {"stable": 1.0, "moderate": 0.6, "hopper": 0.2}
MISSING_PENALTY = 8
MISMATCH_CAP = 35
ALTERNATE_AFFINITY = 0.6
DOMAIN_AFFINITY = 0.5
METROS = {
    "bengaluru": ["bangalore", "bengaluru", "karnataka"],
    "delhi_ncr": ["delhi", "new delhi", "gurugram", "gurgaon", "noida", "ghaziabad",
                  "faridabad", "haryana"],
    "mumbai": ["mumbai", "navi mumbai", "thane", "pune"],
    "hyderabad": ["hyderabad", "secunderabad", "telangana"],
    "chennai": ["chennai", "tamil nadu"],
}

# Recency and class resolution.
HALF_LIFE_MONTHS = 36.0
ALT_RATIO = 0.35
MAX_ALTERNATES = 2

# Tenure bands.
HOPPER_AVG = 15.0
HOPPER_STARTS = 3
STABLE_AVG = 30.0
RECENT_MONTHS = 36

# Match confidences.
CONF_EXACT = 1.0
CONF_PHRASE = 0.90
CONF_CONTEXT_STRONG = 0.80
CONF_CONTEXT_WEAK = 0.60
CONTEXT_STRONG_SCORE = 2.0
CONF_TOKEN = 0.75
CONTEXT_MIN_SCORE = 1.0
CONTEXT_MIN_MARGIN = 0.5
FALLBACK_MIN_PROBABILITY = 0.45
FALLBACK_SCALE = 0.9
CENTROID_MIN_COSINE = 0.35

# Switch intent: base, term weights and band edges.
INTENT_BASE = -0.85
INTENT_WEIGHTS = {
    "open_to_work": 1.30,
    "seeking_language": 0.50,
    "career_break": 0.45,
    "overdue_for_a_move": 0.40,
    "hopper": 0.30,
    "freelance_or_contract": 0.25,
    "just_started": -0.60,
    "founder_or_self_employed": -0.30,
}
INTENT_LOW = 0.35
INTENT_HIGH = 0.65
SEEKING_PHRASES = [
    "looking for", "open to", "seeking", "available for", "actively looking",
    "actively seeking", "interested in new", "new opportunities", "hire me",
    "immediate joiner",
]
BREAK_PHRASES = ["career break", "returning to work", "sabbatical", "on a break", "relaunch"]
FREELANCE_PHRASES = ["freelance", "freelancer", "contract", "contractor", "consultant"]
FOUNDER_PHRASES = ["founder", "co-founder", "cofounder", "self-employed", "self employed", "ceo"]
TRANSITION_PHRASES = [
    "transitioning to", "transition to", "aspiring", "switching to", "pivoting to",
    "career change", "moving into", "breaking into", "want to become",
]

# Confidence penalties and clamp.
CONFIDENCE_PENALTIES = {
    "headline_family_mismatch": 0.15,
    "high_skill_noise": 0.10,
    "headline_seniority_inflated": 0.10,
    "no_experience_descriptions": 0.20,
    "duration_mismatch": 0.15,
    "date_parse_failure": 0.10,
    "fallback_classifier_used": 0.15,
    "thin_history": 0.20,
    "unclassified_entries": 0.15,
}
CONFIDENCE_FLOOR = 0.05
CONFIDENCE_CEILING = 0.99
LOW_CONFIDENCE = 0.50

# Level words.
MANAGER_TITLES = [
    "engineering manager", "head of", "director", "vp", "vice president", "cto",
    "senior engineering manager", "engineering director",
]
STAFF_TITLES = [
    "staff", "principal", "distinguished", "fellow", "architect", "sde-3", "sde 3",
    "sde iii", "sde-iii", "senior staff",
]
# Headline level patterns, first match wins.
HEADLINE_LEVELS = [
    (r"\b(chief technology officer|cto|vp of engineering|vice president)\b", "manager"),
    (r"\b(engineering manager|head of|director|em)\b", "manager"),
    (r"\b(staff|principal|distinguished|fellow|architect)\b", "staff+"),
    (r"\bsde[-\s]?(3|iii)\b", "staff+"),
    (r"\b(senior|sr\.?|lead)\b", "senior"),
    (r"\b(associate|junior|jr\.?)\b", "junior"),
    (r"\b(intern|trainee|fresher|graduate engineer)\b", "intern"),
]

# Ownership verbs that evidence shipped work.
OWNERSHIP_VERBS = [
    "own", "owns", "owned", "ownership", "shipped", "launched", "built", "rewrote",
    "migrated", "migration", "moved", "cut", "reduced", "scaled", "led", "drove",
    "delivered", "maintained", "trained", "designed", "implemented", "quantized",
    "repartitioning",
]

# Requirement parsing.
EVIDENCE_MARKERS = [
    "ownership", "owned", "own ", "shipped", "shipping", "production", "in prod",
    "at scale", "experience", "has built", "built and", "end to end", "end-to-end",
    "customer-facing", "customer facing",
]
REQUIREMENT_FILLERS = [
    "equivalent", "any", "preferred", "experience with", "experience in", "a", "an", "the",
]
EVIDENCE_STOP_WORDS = [
    "of", "a", "an", "the", "and", "or", "to", "in", "on", "with", "for", "has", "have",
    "been", "at", "experience", "must",
]
CONCEPT_SYNONYMS = {
    "orchestrator": ["airflow", "prefect", "dagster", "luigi", "oozie", "step functions",
                     "adf", "azure data factory"],
    "cloud warehouse": ["snowflake", "bigquery", "redshift", "databricks", "synapse"],
    "vector db": ["faiss", "pgvector", "pinecone", "weaviate", "milvus", "qdrant", "chroma",
                  "vector databases"],
    "offline eval": ["ndcg", "recall@k", "mrr", "map@k", "auc", "offline eval", "evaluation",
                     "llm evaluation"],
    "embeddings": ["embeddings", "sentence-transformers", "faiss", "transformers", "pgvector"],
    "retrieval": ["retrieval", "rag", "faiss", "search", "vector databases"],
    "ranking": ["ranking", "reranker", "ndcg", "learning to rank", "recommender"],
    "mlops": ["mlflow", "mlops", "kubeflow", "sagemaker", "feature store"],
    "inference latency optimisation": ["triton inference server", "onnx", "tensorrt",
                                       "quantization", "latency"],
    "performance work": ["lcp", "latency", "p95", "p99", "performance", "webpack", "bundle"],
    "design system experience": ["design system", "storybook", "component library",
                                 "accessibility"],
}

# Signal codes repeated on the ranking row, by prefix.
CARRIED_CODES = [
    "open_to_work:", "switch_intent:", "tenure_flag:", "headline_declares_transition",
    "headline_seniority_inflated", "skills_not_evidenced_in_experience",
    "zero_role_experience_despite_skill_claim", "low_confidence_extraction",
    "career_break",
]

# Closed vocabulary of reason codes: template name and pattern.
REASON_TEMPLATES = [
    ("headline_declares_transition", r"^headline_declares_transition$"),
    ("headline_seniority_inflated", r"^headline_seniority_inflated$"),
    ("headline_family_mismatch", r"^headline_family_mismatch:[a-z_]+!=[a-z_]+$"),
    ("skills_not_evidenced_in_experience", r"^skills_not_evidenced_in_experience$"),
    ("zero_role_experience_despite_skill_claim", r"^zero_role_experience_despite_skill_claim$"),
    ("off_domain_skills", r"^off_domain_skills:\d+$"),
    ("open_to_work", r"^open_to_work:(true|false)$"),
    ("switch_intent", r"^switch_intent:(low|medium|high)$"),
    ("tenure_flag", r"^tenure_flag:(hopper|moderate|stable)$"),
    ("career_break", r"^career_break$"),
    ("low_confidence_extraction", r"^low_confidence_extraction$"),
    ("fallback_classifier_used", r"^fallback_classifier_used:[a-z_0-9]+$"),
    ("no_experience_descriptions", r"^no_experience_descriptions$"),
    ("date_parse_failure", r"^date_parse_failure$"),
    ("duration_mismatch", r"^duration_mismatch$"),
    ("role_match", r"^role_match:[a-z_]+$"),
    ("role_adjacent", r"^role_adjacent:[a-z_]+~[a-z_]+=[0-9.]+$"),
    ("role_mismatch", r"^role_mismatch:[a-z_]+!=[a-z_]+$"),
    ("years_in_band", r"^years_in_band:[0-9.]+ in \[[0-9.]+,[0-9.]+\]$"),
    ("years_below_min", r"^years_below_min:[0-9.]+<[0-9.]+$"),
    ("years_above_max", r"^years_above_max:[0-9.]+>[0-9.]+$"),
    ("must_have_met", r"^must_have_met:[^|]+(\|evidence=.+)?$"),
    ("must_have_claimed_only", r"^must_have_claimed_only:[^|]+$"),
    ("must_have_missing", r"^must_have_missing:[^|]+$"),
    ("good_to_have_met", r"^good_to_have_met:[^|]+$"),
    ("evidence_of_scale", r"^evidence_of_scale:.+$"),
    ("no_production_ownership", r"^no_production_ownership$"),
    ("location_exact", r"^location_exact:[a-z .]+$"),
    ("location_remote_ok", r"^location_remote_ok$"),
    ("location_mismatch", r"^location_mismatch:[a-z .]+vs[a-z .]+$"),
    ("score_capped_role_mismatch", r"^score_capped_role_mismatch:\d+$"),
]

# Field groups of a profile, and crawl metadata left out of the input hash.
FIELD_GROUPS = ["headline", "about", "skills", "experience", "education", "location",
                "is_open_to_work"]
CRAWL_METADATA = ["created_at", "updated_at", "_observed_at", "_source", "_ingested_at"]

# Signals that each field group can move.
DEPENDENCIES = {
    "headline": ["role_family", "seniority", "switch_intent", "confidence", "reason_codes"],
    "about": ["switch_intent", "confidence", "reason_codes"],
    "skills": ["core_skills", "claimed_skills_unverified", "skill_noise_ratio", "confidence",
               "reason_codes"],
    "experience": ["role_family", "role_family_alt", "seniority", "years_total",
                   "years_relevant", "tenure_stability", "core_skills",
                   "claimed_skills_unverified", "skill_noise_ratio", "switch_intent",
                   "confidence", "reason_codes"],
    "education": ["core_skills", "claimed_skills_unverified", "confidence"],
    "location": [],
    "is_open_to_work": ["switch_intent", "reason_codes"],
}
DOWNSTREAM = {"high": ["re_score", "notify_recruiter"], "medium": ["re_score"], "low": [],
              "noise": []}

# Relevance threshold and cut-offs of the ranking metrics.
RELEVANT_GRADE = 2
BOOTSTRAP_SEED = 20260817
BOOTSTRAP_RESAMPLES = 1000
BOOTSTRAP_LOW = 0.025
BOOTSTRAP_HIGH = 0.975

# Prices (US dollars).
PRICE_VCPU_HOUR = 0.04656
PRICE_GB_HOUR = 0.00511
PRICE_MTOK_IN = 0.10
PRICE_MTOK_OUT = 0.40

# Drift alarm limits.
ALARM_ABSTENTION = 0.25
ALARM_FALLBACK = 0.15
ALARM_CONFIDENCE_DROP = 0.05
ALARM_NOISE_SHARE = 0.40
ALARM_DELETION_RATE = 0.05
ALARM_CLASS_SD = 3.0
ALARM_P95_MS = 8.0

# A class corpus may not shrink below this share of the previous one.
CORPUS_MIN_SHARE = 0.7
# ------------------------------------------------------------ end fixed values
