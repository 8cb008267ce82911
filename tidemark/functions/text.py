"""Cleaning, masking, validation and tokenising as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.pinning import pin
from tidemark.policy import text_patterns as P


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _blank_out(c: Column | str, pattern: str, flags: str = P.UNICODE) -> Column:
    return F.regexp_replace(_col(c), flags + pattern, " ")


def strip_html(c: Column | str) -> Column:
    return _blank_out(c, P.HTML_TAG)


def strip_urls(c: Column | str) -> Column:
    return _blank_out(c, P.URL)


def mask_emails(c: Column | str) -> Column:
    return _blank_out(c, P.EMAIL)


# What a number may begin with is looked for first: most characters are passed over after one comparison.
def mask_ssns(c: Column | str) -> Column:
    return _blank_out(c, r"(?=\d)" + P.SSN)


def mask_cards(c: Column | str) -> Column:
    return _blank_out(c, rf"(?=\d)(?:{P.PAYMENT_CARD})")


def mask_phones(c: Column | str) -> Column:
    return _blank_out(c, r"(?=[+(\d])" + P.PHONE)


def drop_redaction_markers(c: Column | str) -> Column:
    return _blank_out(c, P.REDACTION_MARKER, "(?iU)")


def collapse_punctuation(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), P.REPEATED_PUNCTUATION, "$1 ")


def collapse_whitespace(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), P.UNICODE + P.WHITESPACE, " "))


def clean_text(
    c: Column | str,
    redact_pii: bool = True,
    lowercase: bool = True,
    strip_url: bool = True,
    normalize_markers: bool = True,
) -> Column:
    """Cleaned narrative; null becomes the empty string.

    The order of the steps is part of the semantics. The digit patterns are the
    costly ones, so they run only on text that has a digit at all.
    """
    out = strip_html(F.coalesce(_col(c), F.lit("")))
    if strip_url:
        out = strip_urls(out)
    if redact_pii:
        out = mask_emails(out)
        out = F.when(out.rlike(r"(?U)\d"), mask_phones(mask_cards(mask_ssns(out)))).otherwise(out)
    if normalize_markers:
        out = drop_redaction_markers(out)
    out = collapse_punctuation(out)
    if lowercase:
        out = F.lower(out)
    return collapse_whitespace(out)


def with_clean_text(
    df: DataFrame,
    raw: str = "narrative",
    cleaned: str = "cleaned",
    redact_pii: bool = True,
    lowercase: bool = True,
    strip_url: bool = True,
    normalize_markers: bool = True,
) -> DataFrame:
    """``clean_text`` for bulk use: each costly pattern runs only on text that can match it."""
    text = F.col(cleaned)
    out = df.withColumn(cleaned, F.coalesce(F.col(raw), F.lit("")))

    def only_if(frame, condition, step):
        return frame.withColumn(cleaned, F.when(condition, step(text)).otherwise(text))

    out = only_if(out, F.contains(text, F.lit("<")), strip_html)
    if strip_url:
        out = only_if(out, F.contains(text, F.lit("http")), strip_urls)
    if redact_pii:
        out = only_if(out, F.contains(text, F.lit("@")), mask_emails)
        out = only_if(out, text.rlike(r"(?U)\d"), lambda t: mask_phones(mask_cards(mask_ssns(t))))
    if normalize_markers:
        out = only_if(out, text.rlike("[xX]{2}"), drop_redaction_markers)
    last = collapse_punctuation(text)
    out = out.withColumn(cleaned, collapse_whitespace(F.lower(last) if lowercase else last))
    return pin(out, cleaned)


def word_count(c: Column | str) -> Column:
    """Number of whitespace-separated words; 0 for blank text."""
    flat = collapse_whitespace(c)
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))


def is_blank(c: Column | str) -> Column:
    """Whether a text has nothing but whitespace; looked at up to its first other character."""
    return ~_col(c).rlike(P.UNICODE + r"\S")


def validation_message(raw: Column | str, cleaned: Column | str, min_words: int = 3) -> Column:
    """Why a narrative cannot be processed, or that it can."""
    raw, cleaned = _col(raw), _col(cleaned)
    n = F.when(cleaned == "", 0).otherwise(F.size(F.split(cleaned, " ")))
    return (
        F.when(raw.isNull(), "Input is null or not a string.")
        .when(cleaned == "", "Complaint text is empty or contains only whitespace/PII.")
        .when(
            n < min_words,
            F.concat(
                F.lit("Complaint text is too short ("),
                n.cast("string"),
                F.lit(f" words; minimum required is {min_words})."),
            ),
        )
        .otherwise("Valid complaint text.")
    )


VALID_MESSAGE = "Valid complaint text."


def pii_audit(c: Column | str) -> dict[str, Column]:
    """How many spans of each kind the cleaner masks, in cleaning order.

    Each kind is counted on the text that the previous steps left, so a span is
    counted once, under the pattern that really removes it.
    """
    text = strip_urls(strip_html(F.coalesce(_col(c), F.lit(""))))
    counts = {}
    for name, pattern, flags, mask in [
        ("emails", P.EMAIL, P.UNICODE, mask_emails),
        ("ssns", P.SSN, P.UNICODE, mask_ssns),
        ("cards", P.PAYMENT_CARD, P.UNICODE, mask_cards),
        ("phones", P.PHONE, P.UNICODE, mask_phones),
        ("markers", P.REDACTION_MARKER, "(?iU)", drop_redaction_markers),
    ]:
        counts[name] = F.regexp_count(text, F.lit(flags + pattern))
        text = mask(text)
    return counts


def terms(c: Column | str) -> Column:
    """Lower-case word tokens of at least two characters, in text order."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(P.TERM_TOKEN), F.lit(0))


def terms_text(c: Column | str) -> Column:
    """The same tokens, and words of one character, with blanks between them: one string is stored and sent to Python at little cost."""
    return F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}_]+", " ")


def with_bigrams(tokens: Column | str) -> Column:
    """Unigrams followed by adjacent bigrams."""
    t = _col(tokens)
    pairs = F.zip_with(
        F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))),
        F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(t, pairs)


def python_title(c: Column | str) -> Column:
    """Title case in which every letter run starts with a capital.

    ``initcap`` only restarts after a blank; digits, hyphens and apostrophes
    restart a run here too.
    """
    return F.array_join(
        F.transform(
            F.regexp_extract_all(_col(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)),
            F.initcap,
        ),
        "",
    )


def percent(c: Column | str, digits: int = 1) -> Column:
    """``0.1234`` -> ``12.3%``."""
    return F.format_string(f"%.{digits}f%%", _col(c) * F.lit(100.0))
