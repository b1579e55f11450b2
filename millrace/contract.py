"""What users of the data rely on: texts, names, limits and patterns that must be as they are for results to agree."""

from __future__ import annotations

PROMPT = "Explain the following concept from the document clearly and completely:\n\n"
SYSTEM = "You are a helpful assistant."

#: A file name that may be read: letters, digits, and a few signs.
SAFE_NAME = r"^[\p{L}\p{N}_\-. ]+$"
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
WARN_UPLOAD_BYTES = 10 * 1024 * 1024
MAX_SOURCE_BYTES = 100 * 1024 * 1024
MAX_RECORDS = 500_000

CHUNK_SIZE = 800
OVERLAP = 100
NEAR_DUPLICATE = 0.85

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: (kind, class named in the replacement, pattern), in the order of application: a later pattern sees earlier results.
#: Digits are spelled out, as ``\d`` means other characters to other engines.
PII_PATTERNS: list[tuple[str, str, str]] = [
    ("email", "EMAIL", r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b"),
    ("url", "URL", r"(?i)https?://\S+"),
    ("url", "URL", r"(?i)www\.\S+"),
    ("phone", "PHONE", r"\b[0-9]{3}[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}\b"),
    ("phone", "PHONE", r"\+[0-9]{1,3}[\s-]?\(?[0-9]{1,4}\)?[\s-]?[0-9]{1,4}[\s-]?[0-9]{1,9}\b"),
    ("card", "CARD", r"\b[0-9]{4}(?:[ \-]?[0-9]{4}){3}\b"),
    ("ip", "IP", rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b"),
    ("ssn", "SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
]
#: Texts without a match have no personal data.
PII_CANDIDATE = r"(?i)[@0-9+]|http|www\."
MASK_PHONE, MASK_CARD, MASK_SSN = "***-***-", "****-****-****-", "***-**-"

#: (grade, least records, least average output length, least share of distinct instructions), best first.
GRADES = [("SUPER", 100, 300, 0.95), ("GOOD", 50, 200, 0.85), ("NORMAL", 20, 100, 0.70)]
SHORT_OUTPUTS = "⚠ Outputs are very short — consider using Research mode."
SAME_INSTRUCTIONS = "⚠ Many duplicate instructions — increase dataset_size or source material."
EMPTY_DATASET = "Dataset is empty — no valid records produced."

#: Dollars for a million tokens; the first name that a model's name contains counts.
PRICES = {"gpt-4o": 8.0, "gpt-4o-mini": 0.5, "gpt-4.1": 6.5, "gpt-4.1-mini": 0.35, "gpt-3.5-turbo": 1.0}
DEFAULT_PRICE = 8.0
EVOLUTIONS = {"fast": 1, "balanced": 2, "research": 3}

#: Fields that must be present in each format when it is sanitised.
REQUIRED = {"alpaca": ["instruction", "output"], "sharegpt": ["conversations"], "chatml": ["messages"], "openai": ["messages"]}
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "gpt": "assistant", "system": "system"}
