"""Fixed values of the clause domain.

These values decide results, so they are stated as plain text and kept in one
place: type names, score weights, thresholds, keyword rules and checklist
wording.
"""

# --- fixed values: clause types, in annotation order -------------------------
CLAUSE_TYPES = (
    "payment_terms",
    "termination",
    "ip_assignment",
    "liability",
    "confidentiality",
    "scope_of_work",
    "governing_law",
    "general",
)
DEFAULT_TYPE = "general"
DEFAULT_CONFIDENCE = 0.5
RISK_LEVELS = ("high", "medium", "low")
ACTIVE_STATUSES = ("pending", "running")

# --- fixed values: hybrid score ----------------------------------------------
SEVERITY_PRIOR = {
    "liability": 1.00,
    "ip_assignment": 0.85,
    "termination": 0.70,
    "payment_terms": 0.55,
    "confidentiality": 0.40,
    "scope_of_work": 0.30,
    "general": 0.30,
    "governing_law": 0.20,
}
WEIGHT_MODEL_SCORE = 0.65
WEIGHT_FACTORS = 0.15
WEIGHT_UNCERTAINTY = 0.10
WEIGHT_SEVERITY = 0.10
FACTOR_SATURATION = 4
HYBRID_HIGH = 0.65
HYBRID_MEDIUM = 0.35
MODEL_MEDIUM = 0.4
MODEL_HIGH = 0.7
LOW_CONFIDENCE = 0.40

# --- fixed values: keyword rules (ordered, first hit wins) --------------------
KEYWORD_RULES = (
    ("ip_assignment", 0.92, (
        "intellectual property", "ip ", "ip,", "ownership of work",
        "work product", "inventions", "copyright assignment")),
    ("payment_terms", 0.85, (
        "payment", "invoice", "compensation", "fee", "remuneration",
        "net 30", "net 60", "billing")),
    ("termination", 0.88, (
        "terminat", "cancel", "expir", "end of term", "notice period", "wind down")),
    ("liability", 0.83, (
        "liable", "liability", "indemnif", "damages",
        "limitation of liability", "hold harmless")),
    ("confidentiality", 0.90, (
        "confidential", "non-disclosure", "nda", "proprietary information", "trade secret")),
    ("scope_of_work", 0.80, (
        "scope of work", "deliverables", "services", "obligations",
        "responsibilities", "statement of work")),
    ("governing_law", 0.87, (
        "governing law", "jurisdiction", "dispute resolution",
        "arbitration", "venue", "applicable law")),
)
KEYWORD_DEFAULT = ("general", 0.50)

# --- fixed values: demo scorer -----------------------------------------------
DEMO_BASE_RISK = {
    "liability": 0.75,
    "ip_assignment": 0.70,
    "termination": 0.55,
    "payment_terms": 0.45,
    "confidentiality": 0.35,
    "scope_of_work": 0.30,
    "governing_law": 0.25,
    "general": 0.20,
}
DEMO_BASE_OTHER = 0.30
DEMO_FACTORS = {
    "liability": ("Indemnification obligation present", "No liability cap detected"),
    "ip_assignment": ("Broad IP assignment language", "No carve-out for pre-existing work"),
    "termination": ("Termination terms may be asymmetric",),
    "payment_terms": ("Extended payment window",),
    "confidentiality": ("Confidentiality obligation may be perpetual",),
    "scope_of_work": ("Deliverables depend on external exhibit",),
    "governing_law": ("Fixed forum may add travel/cost burden",),
    "general": (),
}
DEMO_PREFIX = "[Demo analysis"
DEMO_SUMMARY_OPEN = (
    "[Demo analysis — no language model configured] This clause was categorized as ")
DEMO_SUMMARY_SPAN = ". It spans "
DEMO_SUMMARY_CLOSE = (
    " characters. Connect an OpenAI API key in backend/.env to replace this canned text "
    "with a real plain-language explanation.")
DEMO_CONTRACT_OPEN = (
    "[Demo analysis — no language model configured] This contract was segmented into ")
DEMO_CONTRACT_FLAGGED = "Contract-level review also flagged: "
DEMO_CONTRACT_COVERED = (
    "All five commonly expected protection areas (payment, scope, IP, termination, "
    "liability) are addressed by at least one clause.")
DEMO_CONTRACT_CLOSE = (
    "Connect an OpenAI API key in backend/.env to replace this canned text with a real "
    "executive summary.")

# --- fixed values: protections every contract is expected to address ----------
# (pain point, clause type that satisfies it, severity, title, detail)
PROTECTIONS = (
    ("payment_traps", "payment_terms", "high", "No payment terms detected",
     "No payment-terms clause was detected in this contract. Freelance service agreements "
     "typically state the fee, the invoicing schedule, and the payment window — terms that "
     "are much harder to enforce when they are not written down. Their absence is commonly "
     "associated with delayed or disputed payment."),
    ("scope_creep", "scope_of_work", "medium", "No scope of work detected",
     "No scope-of-work clause was detected. Agreements without a written scope commonly "
     "leave deliverables, revision rounds, and acceptance criteria undefined — the pattern "
     "most associated with scope creep and unpaid extra work."),
    ("ip_assignment", "ip_assignment", "medium", "No intellectual-property clause detected",
     "No clause addressing intellectual-property ownership was detected. When a contract is "
     "silent on IP, ownership of the work product — and of any pre-existing tools reused in "
     "it — is left to default law, which varies by jurisdiction and often surprises both "
     "sides."),
    ("termination_asymmetry", "termination", "medium", "No termination clause detected",
     "No termination clause was detected. Without one, the notice period, wind-down "
     "obligations, and payment for work in progress are undefined if either side ends the "
     "engagement early."),
    ("liability_gaps", "liability", "high", "No liability clause detected",
     "No liability or indemnification clause was detected. Contracts that are silent on "
     "liability leave exposure uncapped by default; liability clauses typically address "
     "caps, exclusions of indirect damages, and indemnity obligations."),
)
PAIN_POINTS = tuple(row[0] for row in PROTECTIONS)

# --- fixed values: provision title -> clause type ------------------------------
PROVISION_TYPES = {
    "intellectual property": "ip_assignment",
    "assigns": "ip_assignment",
    "assignments": "ip_assignment",
    "licenses": "ip_assignment",
    "payments": "payment_terms",
    "expenses": "payment_terms",
    "fees": "payment_terms",
    "taxes": "payment_terms",
    "compensation": "payment_terms",
    "costs": "payment_terms",
    "withholdings": "payment_terms",
    "terminations": "termination",
    "expiration": "termination",
    "survival": "termination",
    "indemnifications": "liability",
    "indemnity": "liability",
    "liability": "liability",
    "warranties": "liability",
    "insurance": "liability",
    "disclaimers": "liability",
    "remedies": "liability",
    "releases": "liability",
    "confidentiality": "confidentiality",
    "non-disclosure": "confidentiality",
    "non-disclosures": "confidentiality",
    "publicity": "confidentiality",
    "duties": "scope_of_work",
    "obligations": "scope_of_work",
    "cooperation": "scope_of_work",
    "performance": "scope_of_work",
    "deliveries": "scope_of_work",
    "use of proceeds": "scope_of_work",
    "governing laws": "governing_law",
    "jurisdictions": "governing_law",
    "arbitration": "governing_law",
    "venues": "governing_law",
    "waiver of jury trials": "governing_law",
    "submission to jurisdiction": "governing_law",
    "applicable laws": "governing_law",
}

# --- fixed values: question category -> clause type -----------------------------
QUESTION_TYPES = {
    "Governing Law": "governing_law",
    "Most Favored Nation": "general",
    "Non-Compete": "general",
    "Exclusivity": "general",
    "No-Solicit Of Customers": "general",
    "Competitive Restriction Exception": "general",
    "No-Solicit Of Employees": "general",
    "Non-Disparagement": "confidentiality",
    "Termination For Convenience": "termination",
    "ROFR/ROFO/ROFN": "general",
    "Change Of Control": "termination",
    "Anti-Assignment": "ip_assignment",
    "Revenue/Profit Sharing": "payment_terms",
    "Price Restrictions": "payment_terms",
    "Minimum Commitment": "payment_terms",
    "Volume Restriction": "scope_of_work",
    "IP Ownership Assignment": "ip_assignment",
    "Joint IP Ownership": "ip_assignment",
    "License Grant": "ip_assignment",
    "Non-Transferable License": "ip_assignment",
    "Affiliate License-Licensor": "ip_assignment",
    "Affiliate License-Licensee": "ip_assignment",
    "Unlimited/All-You-Can-Eat-License": "ip_assignment",
    "Irrevocable Or Perpetual License": "ip_assignment",
    "Source Code Escrow": "ip_assignment",
    "Post-Termination Services": "termination",
    "Audit Rights": "scope_of_work",
    "Uncapped Liability": "liability",
    "Cap On Liability": "liability",
    "Liquidated Damages": "liability",
    "Warranty Duration": "liability",
    "Insurance": "liability",
    "Covenant Not To Sue": "liability",
    "Third Party Beneficiary": "general",
}
QUESTION_HIGH_RISK = (
    "Uncapped Liability",
    "Non-Compete",
    "IP Ownership Assignment",
    "Irrevocable Or Perpetual License",
    "Exclusivity",
    "No-Solicit Of Employees",
    "No-Solicit Of Customers",
    "Liquidated Damages",
    "Termination For Convenience",
    "Most Favored Nation",
)
QUESTION_LOW_RISK = (
    "Governing Law",
    "Cap On Liability",
    "Insurance",
    "Warranty Duration",
    "Audit Rights",
    "Notices",
    "Effective Date",
    "Expiration Date",
    "Renewal Term",
    "Anti-Assignment",
)
MIN_SPAN_CHARS = 40

# --- fixed values: targets, gates and limits -------------------------------------
TARGET_PRECISION = 0.75
TARGET_RECALL = 0.70
SWEEP_THRESHOLDS = (0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85)
TARGET_GRADE = 12.0
BOUNDARY_TOLERANCE = 20
MAX_F1_DROP = 0.02
COVERAGE_FLOOR = 0.95
GENERAL_CAP_MULTIPLIER = 1.5
MODEL_GATE = 0.01
MACRO_F1_FLOOR = 0.85
CLASS_F1_FLOOR = 0.75
OUT_OF_DOMAIN_F1_FLOOR = 0.65
FALLBACK_PAGE_CAP = 20
SUMMARY_SAMPLE = 2000
SHINGLE_WORDS = 5
NEAR_DUPLICATE_JACCARD = 0.85
NULL_LABELS = ("", "null", "none", "n/a", "-")
NOT_MEASURED_REASON = "not yet measured - requires an LLM key (Phase 4)"
STALE_RUN_MESSAGE = "Interrupted by a backend restart. Run the analysis again."
ADMISSION_WINDOW_SECONDS = 60
ADMISSION_LIMITS = {"auth": 10, "disclaimer": 60}
