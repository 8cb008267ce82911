"""Patterns of the text cleaner.

``UNICODE`` makes the JVM regex engine treat ``\\b``, ``\\d`` and ``\\s`` as
Unicode classes whatever the Java version.
"""

UNICODE = "(?U)"

# What counts as markup, personal data and filler in a narrative.
HTML_TAG = r"<[^>]+>"
URL = (
    r"https?://(?:www\.)?[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b"
    r"(?:[-a-zA-Z0-9()@:%_+.~#?&/=]*)"
)
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
SSN = r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b"
PAYMENT_CARD = r"\b(?:\d{4}[-\s]?){3}\d{4}\b|\b\d{15,16}\b"
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b"
REDACTION_MARKER = r"\b(?:x{2,}[/-]?)+\b"
REPEATED_PUNCTUATION = r"([!?.,])\1+"
WHITESPACE = r"\s+"

# Word characters, used to build tokens without relying on \b.
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"
NON_WORD_CHAR = r"([^\p{L}\p{N}_ ])"
TERM_TOKEN = r"[\p{L}\p{N}_]{2,}"
