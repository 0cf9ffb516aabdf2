"""Fixed values.

Word lists, patterns, constants and texts in this file are data that results
depend on. They are stated plainly; no logic lives here.
"""

# --- retrieval constants -------------------------------------------------
SNIPPET_CHARS = 2200
SNIPPET_LEAD = 200
TOP_K = 8
RRF_K = 60
DENSE_MIN_SCORE = 0.35
RERANK_POOL = 20
REFUSAL_THRESHOLD = 0.25
EVAL_CONTEXT_POOL = 8
MAX_SESSIONS = 20
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
CHUNK_SIZE, CHUNK_OVERLAP = 1500, 150
CHUNK_SEPARATORS = ("\n\n", "\n", ". ", " ")
MIN_PARAGRAPH_CHARS = 50
MIN_PROVISION_CHARS = 40
MIN_FILE_CHARS = 200
CLAIM_MIN_CHARS = 25
CLAIM_TEXT_CHARS = 240
CLAIM_TRACE_ITEMS = 8
NGRAM_WORDS = 3
UPLOAD_EXTENSIONS = ("pdf", "docx", "txt", "md")
REFUSAL_TEXT = "I do not have authoritative source material for this question."

# --- token patterns ------------------------------------------------------
WORD_PATTERN = "[a-z0-9£]+"
CONTENT_WORD_PATTERN = "[a-z]{3,}"

CONTENT_STOP_WORDS = """
the and for with that this these those from into such have has had been being will would
may must shall should can any all are was were but not you your our his her its
they their them who what when where why how which whose whom between under over about above
below before after during through until while because although however therefore thus also only
than then there here more less most least each every some many few other another same
uses used use
""".split()

RELAXED_STOP_WORDS = """
a an and are as at be by for from has have if in into is it its of on or that the their there
these this to was were will with within without over under may must shall should could would can
""".split()

# --- citation patterns ---------------------------------------------------
# (label, canonical prefix, qualified pattern, pattern inside the same document)
STATUTES = [
    ("FSMA", "FSMA 2000 s.", r"\bFSMA\s*(?:2000)?\s*(?:section|sec|s)\.?\s*(\d+[A-Za-z]?)\b", r"\b(?:section|sec|s)\.?\s*(\d+[A-Za-z]?)\b"),
    ("RAO", "RAO 2001 art.", r"\bRAO\s*(?:2001)?\s*(?:article|art)\.?\s*(\d+[A-Za-z]?)\b", r"\b(?:article|art)\.?\s*(\d+[A-Za-z]?)\b"),
    ("MLR", "MLR 2017 reg.", r"\bMLR\s*(?:2017)?\s*(?:regulation|reg)\.?\s*(\d+[A-Za-z]?)\b", r"\b(?:regulation|reg)\.?\s*(\d+[A-Za-z]?)\b"),
    ("PSR", "PSR 2017 reg.", r"\bPSR\s*(?:2017)?\s*(?:regulation|reg)\.?\s*(\d+[A-Za-z]?)\b", r"\b(?:regulation|reg)\.?\s*(\d+[A-Za-z]?)\b"),
    ("UK MAR", "UK MAR art.", r"\bUK[\s_-]?MAR\s*(?:article|art)\.?\s*(\d+[A-Za-z]?)\b", r"\b(?:article|art)\.?\s*(\d+[A-Za-z]?)\b"),
]
STATUTE_DOCUMENTS = {"FSMA": "FSMA 2000", "RAO": "RAO 2001", "MLR": "MLR 2017", "PSR": "PSR 2017", "UK MAR": "UK MAR"}
HANDBOOK_BOOKS = "BCOBS COBS SYSC PRIN CONC ICOBS MCOB PROD DISP COMP COLL DTR FUND MAR".split()
HANDBOOK_PATTERN = r"\b(?:" + "|".join(HANDBOOK_BOOKS) + r")\s+\d+(?:\.\d+)*[A-Za-z]?(?:R|G)?\b"
HANDBOOK_FILE_STEMS = (
    "COBS BCOBS ICOBS MCOB PROD SYSC PRIN DISP DTR COMP COLL CONC MAR FUND PERG EG DEPP GEN".split()
)

# near-miss rewrites, applied in this order, case-insensitively
CITATION_REWRITES = [
    (r"\bCOBS\s+4\.2\b", "COBS 4.2.1R"),
    (r"\bCOBS\s+9A\b", "COBS 9A.2"),
    (r"\bFSCS\b.*£\s*85[, ]?000", "COMP 10.2"),
    (r"\bFSMA\b.*(general\s+prohibition|s\.?19)", "FSMA 2000 s.19"),
    (r"\bRAO\b.*(advis|arrang)", "RAO 2001 art.53"),
    (r"\bRAO\b.*art\.?\s*25\b", "RAO 2001 art.25"),
    (r"\bMLR\s*2017.*(CDD|due diligence|reg\.?\s*27)", "MLR 2017 reg.27"),
    (r"\bMLR\s*2017.*(HRTC|high[- ]?risk|reg\.?\s*33)", "MLR 2017 reg.33"),
    (r"\bPSR\s*2017.*(unauthorised|unauthorized|reg\.?\s*77)", "PSR 2017 reg.77"),
    (r"\bPSR\s*2017.*reg\.?\s*7[8-9]\b", "PSR 2017 reg.78"),
    (r"\bUK\s*MAR.*(inside information|art\.?\s*17)", "UK MAR art.17"),
    (r"\bUK\s*MAR.*(insider list|art\.?\s*18)", "UK MAR art.18"),
    (r"\bDTR\s*2\b", "DTR 2"),
    (r"\bPROD\s*4\b", "PROD 4"),
    (r"\bICOBS\s*7\b", "ICOBS 7"),
]
# the same first rule, but leaving an already complete rule number alone
IDEMPOTENT_FIRST_REWRITE = r"\bCOBS\s+4\.2\b(?!\.\d)"

# allow-lists: "strict" wants an R or G at the end of six books
ALLOW_STRICT = [
    r"FSMA\s*2000\s*s\.?\s*\d+[A-Za-z]?",
    r"COBS\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)",
    r"SYSC\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)",
    r"PRIN\s*\d+(?:\.\d+)*",
    r"CONC\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)",
    r"ICOBS\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)",
    r"MCOB\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)",
    r"PROD\s*\d+(?:\.\d+)*",
    r"DISP\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)",
    r"COMP\s*\d+(?:\.\d+)*",
    r"COLL\s*\d+(?:\.\d+)*",
    r"UK\s*MAR\s*art\.?\s*\d+[A-Za-z]?",
    r"MLR\s*2017\s*reg\.?\s*\d+[A-Za-z]?",
    r"PSR\s*2017\s*reg\.?\s*\d+[A-Za-z]?",
    r"RAO\s*2001\s*art\.?\s*\d+[A-Za-z]?",
    r"DTR\s*\d+(?:\.\d+)*",
]
ALLOW_LENIENT = [
    r"FSMA\s*2000\s*s\.?\s*\d+[A-Za-z]?",
    r"COBS\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)?",
    r"SYSC\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)?",
    r"PRIN\s*\d+(?:\.\d+)*",
    r"CONC\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)?",
    r"ICOBS\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)?",
    r"MCOB\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)?",
    r"PROD\s*\d+(?:\.\d+)*",
    r"DISP\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)?",
    r"COMP\s*\d+(?:\.\d+)*",
    r"COLL\s*\d+(?:\.\d+)*",
    r"UK\s*MAR\s*art\.?\s*\d+[A-Za-z]?",
    r"MLR\s*2017\s*reg\.?\s*\d+[A-Za-z]?",
    r"PRA\s*Rulebook\s*CRR\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)?",
    r"PSR\s*2017\s*reg\.?\s*\d+[A-Za-z]?",
    r"RAO\s*2001\s*art\.?\s*\d+[A-Za-z]?",
    r"RAO\s*2001\s*Sch\.?\s*\d+[A-Za-z]?",
    r"DTR\s*\d+(?:\.\d+)*",
]
ALLOW_RELAXED = [
    r"FSMA\s*2000\s*s\.?\s*\d+[A-Za-z]?",
    r"COBS\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)?",
    r"SYSC\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)?",
    r"PRIN\s*\d+(?:\.\d+)*",
    r"CONC\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)?",
    r"ICOBS\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)?",
    r"MCOB\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)?",
    r"PROD\s*\d+(?:\.\d+)*",
    r"DISP\s*\d+(?:\.\d+)*[A-Z]?(?:R|G)?",
    r"COMP\s*\d+(?:\.\d+)*",
    r"COLL\s*\d+(?:\.\d+)*",
    r"UK\s*MAR(?:\s*art\.?\s*\d+[A-Za-z]?)?",
    r"MLR\s*2017\s*reg\.?\s*\d+[A-Za-z]?",
    r"PSR\s*2017\s*reg\.?\s*\d+[A-Za-z]?",
    r"RAO\s*2001\s*art\.?\s*\d+[A-Za-z]?",
    r"DTR\s*\d+(?:\.\d+)*",
]
FIRST_CITATION = [p for p in ALLOW_LENIENT if "Rulebook" not in p and "Sch" not in p]
BAD_TOKENS = [r"\[[0-9]+(?:†)?\]", r"https?://\S+", r"\bFCAS\b", r"\bFPM\b", r"\bPFB\b", r"\bSMDR\b"]
STRICT_BOOK_NAMES = r"FSMA|COBS|SYSC|PRIN|CONC|ICOBS|MCOB|PROD|DISP|COMP|COLL|UK\s*MAR|MLR|PSR|RAO|DTR"
LENIENT_BOOK_NAMES = r"FSMA|COBS|SYSC|PRIN|CONC|ICOBS|MCOB|PROD|DISP|COMP|COLL|UK\s*MAR|MLR|PRA\s*Rulebook|PSR|RAO|DTR"
CANDIDATE_SPLIT = r"[;|\n,•\-–—]+"
BRACKET_SNIPPET = r"(?:^|[(\[])([^()\[\]\n]{3,80})(?:[)\]]|$)"
PLACEHOLDER_PATTERN = r"(?:^|\s)(?:gold[- ]?standard\s+answer|placeholder|tbd|todo|stub|fixture|n/?a)\b"
SOURCE_LINE_PATTERN = r"^\s*[*_]*\s*source\s*[:\-–]\s*(.+?)\s*$"
SOURCE_LINE_FALLBACK = r"^\s*[*_]*source[*_]*\s*[:\-–]\s*(.+)$"
SOURCE_SPLIT = r"\s*[|;,/]\s*"
CITATION_ALIASES = {
    "principles 12": "PRIN 12",
    "principle 12": "PRIN 12",
    "principe 12": "PRIN 12",
    "mar": "UK MAR",
    "ukmar": "UK MAR",
    "mlr 27": "MLR 2017 reg.27",
    "psr 77": "PSR 2017 reg.77",
    "mlr27": "MLR 2017 reg.27",
    "psr77": "PSR 2017 reg.77",
}

# --- graph dimensions ----------------------------------------------------
REGULATORS = [
    ("FCA", "Financial Conduct Authority"),
    ("PRA", "Prudential Regulation Authority"),
    ("HMT", "His Majesty's Treasury"),
    ("ESMA", "European Securities and Markets Authority"),
    ("BoE", "Bank of England"),
]
DOCUMENTS = [
    ("FSMA 2000", "Financial Services and Markets Act 2000", "primary"),
    ("RAO 2001", "FSMA 2000 (Regulated Activities) Order 2001", "secondary"),
    ("MLR 2017", "Money Laundering Regulations 2017", "secondary"),
    ("PSR 2017", "Payment Services Regulations 2017", "secondary"),
    ("UK MAR", "UK Market Abuse Regulation (retained)", "retained_eu"),
]
# slug, document, short name, regulator, domain, citation kind
LEGISLATION_SOURCES = [
    ("fsma_2000", "FSMA 2000", "FSMA 2000", "HMT", "FSMA", "s"),
    ("rao_2001", "Regulated Activities Order 2001", "RAO 2001", "HMT", "FSMA", "art"),
    ("mlr_2017", "Money Laundering Regulations 2017", "MLR 2017", "HMT", "AML", "reg"),
    ("psr_2017", "Payment Services Regulations 2017", "PSR 2017", "HMT", "Payments", "reg"),
    ("uk_mar", "UK Market Abuse Regulation", "UK MAR", "FCA", "Market", "art"),
]
DEFINED_BY_PAIRS = [("FSMA 2000 s.19", "RAO 2001 art.5")]
# built-in sample: id, cite, title, text, module, domain, terms, threshold, deadline
SAMPLE_PROVISIONS = [
    ("FSMA19", "FSMA 2000 s.19", "General prohibition", "Offence to carry on a regulated activity in the UK unless authorised or exempt.", "FSMA", "FSMA", "regulated activity|authorised|exempt", "", ""),
    ("RAO5", "RAO 2001 art.5", "Meaning of regulated activities", "Defines regulated activity and exemptions context.", "RAO", "FSMA", "regulated activity|exemption", "", ""),
    ("RAO25", "RAO 2001 art.25", "Arranging deals", "Arranging, bringing about or making arrangements with a view to transactions.", "RAO", "MiFID", "arranging deals|intermediation", "", ""),
    ("RAO53", "RAO 2001 art.53", "Advising on investments", "Giving advice on investments/personal recommendations.", "RAO", "MiFID", "personal recommendation|advice", "", ""),
    ("COBS4", "COBS 4.2.1R", "Financial promotions—fair, clear & not misleading", "A firm must ensure a communication or a financial promotion is fair, clear and not misleading.", "FCA", "Conduct", "financial promotion|fair clear not misleading", "", ""),
    ("PRIN12", "PRIN 12", "Consumer Duty", "Act in good faith; avoid foreseeable harm; enable good outcomes; fair value.", "FCA", "Conduct", "Consumer Duty|fair value|good outcomes", "", ""),
    ("SYSC10", "SYSC 10", "Conflicts of interest", "Identify, prevent, manage, and disclose conflicts; maintain policies and records.", "FCA", "Governance", "conflicts of interest|register|policy", "", ""),
    ("ICOBS7", "ICOBS 7", "Cancellation rights (insurance)", "Cooling-off rights: typically 14 days; 30 days for pure protection/life.", "FCA", "Insurance", "cancellation|cooling off", "", "14/30 days"),
    ("COMP10_2", "COMP 10.2", "FSCS deposit protection", "£85,000 per person per firm for eligible deposits; joint accounts handled separately.", "FCA", "Prudential", "FSCS|deposit protection", "£85,000", ""),
    ("MLR27", "MLR 2017 reg.27", "Customer due diligence", "Identify and verify customer & beneficial owner; ongoing monitoring obligations.", "HMT", "AML", "CDD|due diligence|beneficial owner", "", ""),
    ("MLR33", "MLR 2017 reg.33", "Enhanced due diligence", "EDD for high-risk third countries and other specified triggers.", "HMT", "AML", "EDD|high risk third countries|HRTC", "", ""),
    ("PSR77", "PSR 2017 reg.77-80", "Unauthorised payment liability & refund", "Payer liability is capped unless fraud/gross negligence; PSP must refund promptly; SCA rules apply.", "HMT", "Payments", "unauthorised payment|SCA|refund", "£35", ""),
    ("UKMAR17", "UK MAR art.17", "Disclose inside information", "Issuers disclose inside information as soon as possible; delay permitted subject to conditions.", "ESMA", "Market", "inside information|disclosure|delay", "", ""),
    ("UKMAR18", "UK MAR art.18", "Insider lists", "Maintain and provide insider lists to the FCA on request.", "ESMA", "Market", "insider list|issuer|FCA request", "", ""),
    ("DTR2", "DTR 2", "Disclosure rules", "Periodic and ongoing disclosure framework aligned with market abuse regime.", "FCA", "Market", "disclosure|issuer", "", ""),
    ("SYSC15A", "SYSC 15A", "Operational resilience", "Identify important business services; set impact tolerances; mapping and scenario testing.", "FCA", "Ops", "operational resilience|impact tolerance|IBS", "", ""),
    ("PROD4", "PROD 4", "Product governance", "Target market; distribution; fair value across the product lifecycle.", "FCA", "Conduct", "product governance|fair value", "", ""),
]

# --- message intents -----------------------------------------------------
FINANCE_WORDS = [
    r"\bloan\b", r"\bcredit\b", r"\bsecurity\b", r"\bcovenant", r"\bPRA\b", r"\bFCA\b", r"\bCRR\b", r"\bfacility\b",
    r"\bdebenture\b", r"\bcharge\b", r"\bUK finance\b", r"\bmifid\b", r"\bregulation\b", r"\bfsma\b", r"\bcobs\b",
    r"\bsysc\b", r"\bprin\b", r"\bconc\b", r"\bicobs\b", r"\bmortgage\b", r"\bmlr\b", r"\bmar\b", r"\bprod\b",
    r"\bdisp\b", r"\brao\b", r"\bpsr\b", r"\bdtr\b",
]
REVIEW_WORDS = [
    r"\btraffic[ -]?light\b", r"\bred flags?\b", r"\brisk review\b", r"\baudit\b", r"\bissues?\b",
    r"\bgreen\b.*\byellow\b.*\bamber\b.*\bred\b",
]
GREETING_PHRASES = (
    r"hi|hello|hey|yo|hiya|hi there|hello there|hey there|good\s+(?:morning|afternoon|evening|day)|"
    r"thanks|thank\s+you|cheers|ty|thx|much\s+appreciated|bye|goodbye|see\s+you|see\s+ya|cya|later|"
    r"ok|okay|got\s+it|cool|nice|great|awesome|how\s+are\s+you(?:\s+doing)?|how'?s\s+it\s+going|what'?s\s+up|sup|"
    r"who\s+are\s+you|what\s+are\s+you|what\s+can\s+you\s+do|what\s+do\s+you\s+do|what\s+is\s+this|help|introduce\s+yourself"
)
META_PHRASES = (
    r"who\s+are\s+you|what\s+are\s+you|what\s+can\s+you\s+do|what\s+do\s+you\s+do|what\s+is\s+this|help|introduce\s+yourself"
)
FRUSTRATION_WORDS = (
    r"wtf|tf|wth|fml|stupid|broken|sucks?|fuck(?:ing)?|shit|damn|crap|this\s+doesn'?t\s+work|doesn'?t\s+work|"
    r"not\s+working|hate\s+this|worst|useless|garbage|trash"
)

# --- answer post-processing texts ----------------------------------------
SHORT_ANSWER_CHARS = 80
# (pattern on the question, answer body, sources), first match wins
FALLBACK_ANSWERS = [
    (r"\bgeneral prohibition\b",
     "The UK general prohibition makes it an offence to carry on a regulated activity unless authorised or an exemption applies.",
     "FSMA 2000 s.19 | RAO 2001 art.5"),
    (r"\bfinancial promotion\b|\bfair,? clear\b|\bnot misleading\b",
     "Financial promotions must be fair, clear and not misleading; restrictions apply unless approved by an authorised firm or an exemption applies.",
     "COBS 4.2.1R | COBS 4"),
    (r"\bunauthorised\b.*payment",
     "For unauthorised payments, payer liability is capped (typically £35 unless fraud/gross negligence) and the PSP must refund promptly, subject to exceptions.",
     "PSR 2017 reg.77-80"),
]
INVALID_FOOTER = (
    "\n\n> ⚠️ One or more citations could not be verified against UK short-forms. "
    "Please cross-check sources (FSMA 2000, FCA Handbook COBS/SYSC/PRIN/CONC/ICOBS/MCOB/PROD/DISP/COMP/COLL, "
    "PSR 2017, RAO 2001, UK MAR, DTR, MLR 2017)."
)
UNGROUNDED_FOOTER = "\n\n> ⚠️ The following citations could not be matched against the graph: "
NOT_RETRIEVED_WARNING = (
    "Citation(s) not present in retrieved sources: ",
    ". Verify manually against legislation.gov.uk / FCA Handbook.",
)
# section, header pattern, rendered header, default bullet
RISK_SECTIONS = [
    ("green", r"##\s*🟢\s*Green Areas", "## 🟢 Green Areas", "- No clear strengths identified from the supplied material."),
    ("yellow", r"##\s*🟡\s*Yellow Areas", "## 🟡 Yellow Areas", "- Clarifications required on scope, controls, or records — COBS 4"),
    ("amber", r"##\s*🟠\s*Amber Areas", "## 🟠 Amber Areas", "- Potential non-conformity needs remediation — MLR 2017 reg.27"),
    ("red", r"##\s*🔴\s*Red Areas", "## 🔴 Red Areas", "- Critical breach / general prohibition risk — FSMA 2000 s.19"),
]

# --- evaluation word lists -----------------------------------------------
KEYWORD_SYNONYMS = {
    "impact tolerance": ["impact tolerances"],
    "consumer duty": ["duty", "prin 12"],
    "customer due diligence": ["cdd", "due diligence"],
    "enhanced due diligence": ["edd"],
    "strong customer authentication": ["sca"],
    "financial promotion": ["fair clear not misleading", "cobs 4"],
    "arranging deals": ["ra o 25", "rao 25", "art 25"],
    "advising on investments": ["rao 53", "art 53"],
    "unauthorised payment": ["unauthorized payment"],
}
LEGAL_TERMS = [
    "regulated activity", "authorised", "exempt", "financial promotion", "suitability",
    "personal recommendation", "conflicts of interest", "operational resilience",
    "consumer duty", "fair value", "cooling off", "cancellation", "inside information",
    "insider list", "customer due diligence", "enhanced due diligence",
    "unauthorised payment", "refund", "strong customer authentication", "complaint",
    "ombudsman", "£85,000", "impact tolerance", "important business services",
    "appointed representative", "arranging deals", "advising on investments",
]
RELAXED_PHRASES = [
    "regulated activity", "authorised", "authorization", "authorisation", "exempt", "appointed representative",
    "financial promotion", "fair clear not misleading", "due diligence", "customer due diligence", "cdd", "edd",
    "inside information", "insider list", "market abuse", "consumer duty", "good outcomes", "fair value",
    "operational resilience", "impact tolerance", "important business services",
    "complaints", "fos", "ombudsman", "fscs", "deposit protection",
]
RELAXED_ACRONYMS = [
    "mlr", "psr", "rao", "fsma", "cobs", "sysc", "prin", "conc", "icobs", "mcob", "prod", "disp", "comp", "dtr", "uk mar",
]
RELAXED_SYNONYMS = {
    "due diligence": ["due diligence", "cdd", "customer due diligence"],
    "enhanced due diligence": ["enhanced due diligence", "edd"],
    "consumer duty": ["consumer duty", "good outcomes", "fair value"],
    "inside information": ["inside information", "mar", "uk mar"],
    "complaint": ["complaint", "complaints", "fos", "ombudsman"],
    "financial promotion": ["financial promotion", "fair clear not misleading", "cobs 4"],
    "regulated activity": ["regulated activity", "fsma", "rao"],
}
RELAXED_TOP_TOKENS = 12
COMPLEXITY_ALIASES = {"adv": "advanced", "hard": "advanced", "mid": "intermediate", "easy": "basic"}
COMPLEXITY_ORDER = ["basic", "intermediate", "advanced"]
COMPLIANCE_ALIASES = {
    "potential issue": "Potential issue",
    "potential_issue": "Potential issue",
    "noncompliant": "Non-compliant",
    "non_compliant": "Non-compliant",
    "compliant": "Compliant",
}
COMPLIANCE_ORDER = ["Compliant", "Potential issue", "Non-compliant"]

# question columns of the flexible-header reader: target -> (headers by priority, default where none is there)
QUESTION_COLUMNS = {
    "question": ("question question_text prompt prompt_text task task_text query query_text scenario scenario_text case case_like "
                 "instruction instructions title summary description body content doc_task document_task document_tasks".split(), None),
    "gold_answer": ("gold_answer reference reference_answer ideal_answer target expected expected_output answer_ref label_text solution explanation".split(), ""),
    "domain": ("domain legal_domain finance_domain area topic".split(), "unspecified"),
    "complexity": ("complexity level difficulty grade".split(), "intermediate"),
    "expected_keywords": ("expected_keywords keywords key_terms".split(), ""),
    "expected_citations": ("expected_citations citations sources".split(), ""),
    "compliance_class": ("compliance_class risk_class class risk_level compliance_status label category".split(), ""),
}
# without a question header, a column of this median length can be the question
QUESTION_MEDIAN_CHARS = 10
# of files that share a base name the one with the first of these extensions is read
QUESTION_EXTENSIONS = ["csv", "parquet"]
