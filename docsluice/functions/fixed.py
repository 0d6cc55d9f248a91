"""Patterns, word lists and replacements that results must agree on. Data only; what is done with them is in text."""

from __future__ import annotations

# ---- fixed values: cleaning of scanned text, in order

PDF_ARTIFACTS = r"[﻿​‌‍  ]+"
BOX_DRAWING = r"[─-╿]+"
ORPHAN_DIACRITICS = r"(?U)[̀-ͯ]+(?!\w)"
MIXED_SCRIPT_NOISE = r"(?<=[a-zA-Z0-9\s.,;:!?\-])[ऀ-ॿ઀-૿ঀ-৿]{1,5}(?=[a-zA-Z0-9\s.,;:!?\-])"
REPEATED_CHARS = r"(.)\1{5,}"
ASTERISK_NOISE = r"\*{2,}"
REPEATED_PUNCTUATION = r"([.:*'\"]{2,}\s*){2,}"
PUNCTUATION_GIBBERISH = r"(?<![a-zA-Z])[.:*'\"_\-,;!?\s]{6,}(?![a-zA-Z])"
SPECIAL_CHAR_GARBAGE = r"(?U)[^\w\s.,;:!?\-'\"(){}\[\]@#$%&*+=/<>]{3,}"
EXCESSIVE_WHITESPACE = r"[ \t]{3,}"
EXCESSIVE_NEWLINES = r"\n{4,}"

# ---- fixed values: letters that a scan puts for digits, in order

OCR_DIGITS = [
    (r"(\d),OOO", "$1,000"), (r"(\d),OO", "$1,00"), (r"(\d+)O(\d+)", "$10$2"), (r"^O(\d)", "0$1"), (r"(\d)O$", "$10"), (r"(\d)O", "$10"), (r"O(\d)", "0$1"),
    (r"(\d)l(\d)", "$11$2"), (r"(\d)l", "$11"), (r"(\d)I(\d)", "$11$2"), (r"Rs\.\s*S(\d)", "Rs. 5$1"), (r"(\d)B(\d)", "$18$2"),
    (r"^O(\d)[/\-]", "0$1/"), (r"[/\-]O(\d)[/\-]", "/0$1/"), (r"(\d{1,2})[/\-]O(\d)", "$1/0$2"), (r"Rs\.\s*l(\d)", "Rs. 1$1"), (r"Rs\.\s*I(\d)", "Rs. 1$1"), (r"Section\s+(\d+)\s*O\s*\)", "Section $1()"),
]

# ---- fixed values: dates

DATE_NUMERIC = r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})\b"
DATE_LEGAL = r"(?i)dated\s+(\d{1,2})(?:st|nd|rd|th)?\s+(?:of\s+)?(\w+)[,\s]+(\d{4})"
DATE_WRITTEN = r"(?i)\b(\d{1,2})(?:st|nd|rd|th)?\s+(?:of\s+)?(\w+)[,\s]+(\d{4})\b"
DATE_ISO = r"\b(\d{4})-(\d{2})-(\d{2})\b"
MONTHS = {
    "january": "01", "jan": "01", "february": "02", "feb": "02", "march": "03", "mar": "03", "april": "04", "apr": "04", "may": "05", "june": "06", "jun": "06", "july": "07", "jul": "07",
    "august": "08", "aug": "08", "september": "09", "sep": "09", "sept": "09", "october": "10", "oct": "10", "november": "11", "nov": "11", "december": "12", "dec": "12",
}

# ---- fixed values: citations, section headers, contents pages

CITE_SECTION = r"(?i)section\s+(\d+[A-Z]{0,2}(?:\s*\(\s*\d+\s*\))?(?:\s*\(\s*[a-z]\s*\))?)(?:\s+(?:of\s+)?(?:the\s+)?)?([A-Z][A-Za-z\s,&]+(?:Act|Code|Rules))(?:,?\s*(\d{4}))?"
CITE_SHORT = r"(?i)\bs(?:ec)?\.?\s*(\d+[A-Z]{0,2}(?:\s*\(\s*\d+\s*\))?)\s+(?:of\s+)?(?:the\s+)?([A-Z][A-Za-z\s\.]+(?:Act|Code))"
CITE_UNDER = r"(?i)u/s\s*\.?\s*(\d+[A-Z]{0,2}(?:\s*\(\s*\d+\s*\))?)\s+(?:of\s+)?([A-Z][A-Za-z\s\.]+)"
CITE_RANGE = r"(?i)sections?\s+(\d+)\s*[-–to]+\s*(\d+)\s+(?:of\s+)?([A-Z][A-Za-z\s\.]+(?:Act|Code)?)"
CITE_READ_WITH = r"(?i)section\s+(\d+[A-Z]{0,2})\s+read\s+with\s+section\s+(\d+[A-Z]{0,2})"
CITATION_CONFIDENCE = 75.0
SECTION_HEADERS = [
    r"(?im)^Section\s+(\d+(?:\([a-zA-Z0-9]+\))?)\s*[.:\-—]?", r"(?m)^(\d+)\.\s+[A-Z]", r"(?im)^\[Section\s+(\d+(?:\([a-zA-Z0-9]+\))?)\]",
    r"(?im)^Sec\.\s*(\d+(?:\([a-zA-Z0-9]+\))?)", r"(?m)^§\s*(\d+(?:\([a-zA-Z0-9]+\))?)",
]
SECTION_REFERENCE = r"(?i)(?:Section|Sec\.?|§)\s*(\d+(?:\s*\([a-zA-Z0-9]+\))*)"
TOC_KEYWORDS = ["arrangement of sections", "table of contents", "contents", "index", "chapter", "part"]
TOC_PAGES, TOC_DEFAULT = 20, (1, 10)

# ---- fixed values: mentions

TITLES = [r"\bShri\b", r"\bSmt\b", r"\bKumari\b", r"\bDr\.?\b", r"\bAdv\.?\b", r"\bAdvocate\b", r"\bHon\.?\b", r"\bHon'ble\b", r"\bJustice\b", r"\bMr\.?\b", r"\bMrs\.?\b", r"\bMs\.?\b"]
ORG_INDICATORS = [r"\bLtd\.?\b", r"\bLimited\b", r"\bPvt\.?\b", r"\bPrivate\b", r"\bCorp\.?\b", r"\bCorporation\b", r"\bInc\.?\b", r"\bBank\b", r"\bCompany\b", r"\bAssociation\b", r"\bTrust\b", r"\bFoundation\b", r"\bBoard\b"]
INSTITUTIONS = ["High Court", "Supreme Court", "District Court", "Sessions Court", "Tribunal", "Authority", "Commission", "Board", "Council"]
COMMON_PHRASES = [
    "the petitioner", "the respondent", "the court", "the above", "the same", "the said", "the matter", "high court", "supreme court", "district court", "civil suit", "writ petition", "special leave",
]

# ---- fixed values: safety

INJECTION = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions?", r"disregard\s+(all\s+)?(previous|prior|above)\s+instructions?", r"forget\s+(all\s+)?(previous|prior|above)\s+instructions?", r"new\s+instructions?:\s*",
    r"system:\s*", r"assistant:\s*", r"</?(system|document_content|user_query|context)>", r"you\s+are\s+now\s+a\s+", r"act\s+as\s+(if\s+you\s+are\s+)?a\s+", r"pretend\s+(to\s+be|you\s+are)\s+", r"override\s+(your\s+)?(instructions?|rules?|guidelines?)",
]
INJECTION_CONTEXT = 30
GUARDS = [
    ("legal_advice_request", r"should\s+(i|we|the\s+client|my\s+client)\s+(file|appeal|settle|sue|proceed|respond|submit)"),
    ("legal_advice_request", r"do\s+you\s+(recommend|advise|suggest)\s+(filing|appealing|settling|suing|proceeding)"),
    ("legal_advice_request", r"what\s+should\s+(i|we)\s+do\s+(next|now|about)"),
    ("outcome_prediction", r"will\s+(the\s+)?(judge|court|tribunal|bench)\s+(rule|decide|hold|find|grant|deny|dismiss)"),
    ("outcome_prediction", r"(what|how)\s+will\s+(the\s+)?(judge|court)\s+(rule|decide)"),
    ("outcome_prediction", r"is\s+the\s+court\s+(likely|going)\s+to"),
    ("outcome_prediction", r"what\s+are\s+(my|our|the|client'?s?)\s+chances"),
    ("outcome_prediction", r"(what|how\s+high)\s+is\s+the\s+(likelihood|probability|chance)\s+of"),
    ("outcome_prediction", r"(will|can)\s+(i|we|they)\s+(win|succeed|prevail)"),
    ("liability_conclusion", r"is\s+(the\s+)?(defendant|plaintiff|accused|client)\s+(guilty|liable|responsible|at\s+fault)"),
    ("liability_conclusion", r"(did|has)\s+(the\s+)?(defendant|plaintiff)\s+(violate|breach|commit)"),
    ("procedural_recommendation", r"should\s+we\s+(appeal|file|submit|respond|withdraw)"),
]
POLICING = [
    (r"violated\s+(section|act|rule|regulation|clause)\s+(\d+[A-Za-z]*)", "affected by $1 $2"), (r"breached\s+(the\s+)?(contract|agreement|terms)", "regarding $1$2 terms"), (r"violated\s+(the\s+)?(agreement|contract|terms)", "regarding $1$2 terms"),
    (r"(defendant|accused|respondent)\s+is\s+guilty(\s+of)?", "$1's liability regarding"), (r"(plaintiff|petitioner|claimant)\s+is\s+entitled(\s+to)?", "$1's potential entitlement to"), (r"(defendant|plaintiff|party|accused)\s+is\s+at\s+fault", "$1's potential responsibility"),
    (r"(the\s+)?court\s+will\s+(rule|decide|hold|find|grant|deny|dismiss)", "$1court may consider"), (r"(the\s+)?judge\s+will\s+(likely\s+)?(rule|decide|find|hold|grant|deny)", "$1judge may"), (r"(the\s+)?tribunal\s+will\s+(rule|decide|hold|find|grant|deny)", "$1tribunal may consider"),
    (r"proves\s+that", "suggests that"), (r"establishes\s+that", "indicates that"), (r"demonstrates\s+that", "may indicate that"), (r"clearly\s+shows", "appears to show"), (r"conclusively\s+(demonstrates|shows|proves)", "may suggest"),
    (r"is\s+liable\s+for", "regarding potential liability for"), (r"is\s+responsible\s+for", "regarding responsibility for"), (r"must\s+pay", "may be required to pay"), (r"is\s+obligated\s+to", "may have obligations regarding"), (r"is\s+bound\s+by", "may be subject to"),
    (r"owes\s+(damages|compensation|payment)", "regarding potential $1"), (r"is\s+negligent", "regarding potential negligence"), (r"committed\s+(fraud|breach|misconduct|negligence)", "regarding potential $1"), (r"in\s+breach\s+of", "regarding compliance with"),
]
DOUBLE_QUOTE = r'"([^"]+)"'
SINGLE_QUOTE = r"(?U)(?<!\w)'([^']+)'(?!\w)"
CITED_SOURCE = r"(?i)(?:as\s+stated\s+in|according\s+to|per|see)\s+(?:\[([^\]]+?)(?:,\s*p(?:age)?\.?\s*(\d+))?\]|\(([^)]+?)(?:,\s*p(?:age)?\.?\s*(\d+))?\)|([A-Z][A-Za-z\s]+?)(?:,\s*p(?:age)?\.?\s*(\d+)))"
BLOCK_QUOTE = r"(?m)^>\s*(.+)$"

# ---- fixed values: intents, each engine's patterns with their confidence

INTENTS = {
    "document_discovery": [(r"\bwhat\s+(documents?|files?)\b", 0.95), (r"\blist\s*(of\s*)?(all\s*)?(the\s*)?(documents?|files?)\b", 0.95), (r"\bwhich\s+(documents?|files?)\b", 0.9), (r"\bhow\s+many\s+(documents?|files?|pages?)\b", 0.9), (r"\bexhibits?\b", 0.8)],
    "entity_lookup": [(r"\bwho\s+is\b", 0.9), (r"\bwho\s+are\s+(the\s+)?(parties?|respondents?|applicants?)\b", 0.95), (r"\b(parties?|respondents?|applicants?|petitioners?)\s+(involved|in\s+this)\b", 0.9), (r"\bwho\s+(filed|initiated|brought)\b", 0.85), (r"\brelationship\s+(between|of)\b", 0.8)],
    "citation": [(r"\b(cite|citation|citations?)\b", 0.9), (r"\bsection\s+\d+", 0.9), (r"\bacts?\s+(of\s+)?\d{4}\b", 0.85), (r"\b(statute|statutory|provisions?)\b", 0.8), (r"\blegal\s+reference", 0.7)],
    "timeline": [(r"\btimeline\b", 0.9), (r"\bchronolog(y|ical|ically)?\b", 0.9), (r"\bsequence\s+(of\s+)?events?\b", 0.85), (r"\bwhen\s+(did|was)\b", 0.7), (r"\b(dates?|order\s+of)\b", 0.6)],
    "contradiction": [(r"\bcontradictions?\b", 0.9), (r"\binconsisten(t|cy|cies)\b", 0.9), (r"\bconflicts?\b", 0.8), (r"\b(differ|dispute|discrepanc)", 0.7), (r"\bdisagree", 0.7)],
    "rag": [(r"\b(summarize|summary)\b", 0.8), (r"\bwhat\s+(is|are|was|were)\b", 0.7), (r"\bexplain\b", 0.7), (r"\btell\s+me\s+about\b", 0.7), (r"\b(search|find|look\s+for)\b", 0.6)],
}

# ---- fixed values: pronouns and the kinds of entity that they may stand for; any kind where none is named

PRONOUNS = {"he": ("person", "male", "unknown"), "him": ("person", "male", "unknown"), "his": ("person", "male", "unknown"), "she": ("person", "female", "unknown"), "her": ("person", "female", "unknown"), "hers": ("person", "female", "unknown"), "it": ("organization", "thing", "document", "unknown"), "its": ("organization", "thing", "document", "unknown")}

# ---- fixed values: kinds of evidence and of contradiction

CONTRADICTIONS = {"date_mismatch": "date_mismatch", "amount_mismatch": "amount_mismatch", "factual_conflict": "factual_contradiction", "semantic_conflict": "semantic_contradiction"}

# ---- fixed values: order of events

#: Kinds of which the first may not come before the second: such violations are high, all others medium.
CRITICAL_SEQUENCES = [("hearing", "filing"), ("order", "filing"), ("order", "hearing")]
#: Years after today, and before the middle of a timeline (warning, critical), from which a date is an outlier; kinds that may lie ahead.
YEARS_AHEAD, YEARS_BEFORE = 2, (10, 30)
AHEAD_KINDS = ["hearing", "deadline"]
#: Windows of a text in which citations are looked for: length, overlap, the stretch at the end in which a sentence may end, and the ends in order.
CITATION_WINDOW, CITATION_OVERLAP, CITATION_BACK = 5000, 500, 1000
SENTENCE_ENDS = [". ", ".\n", ".\r\n", "? ", "! "]
