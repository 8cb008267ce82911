"""Severity signals and tiers."""

from decimal import Decimal

# Signal group -> (weight, keywords in reporting order).
SIGNALS = {
    "financial_harm": (
        Decimal("0.30"),
        ["fraud", "unauthorized", "stolen", "identity theft", "scam", "forged", "forgery",
         "wire fraud", "phishing", "hacked", "compromised", "fraudulent", "counterfeit"],
    ),
    "urgency": (
        Decimal("0.25"),
        ["immediate", "emergency", "urgent", "locked out", "frozen", "cannot access", "blocked",
         "suspended", "closed without", "time sensitive", "deadline", "foreclosure",
         "repossession"],
    ),
    "legal_regulatory": (
        Decimal("0.20"),
        ["attorney", "lawyer", "lawsuit", "court", "violation", "arrest", "fcra", "fdcpa",
         "cfpb", "ftc", "legal", "legal action", "sue", "regulatory", "compliance",
         "fair credit", "cease and desist", "harass", "harassment", "unlawful",
         "garnishment"],
    ),
    "unresolved_persistent": (
        Decimal("0.15"),
        ["unresolved", "ignored", "multiple times", "months", "still not resolved",
         "no response", "repeatedly", "ongoing", "year", "several attempts", "numerous",
         "no resolution"],
    ),
    "financial_magnitude": (
        Decimal("0.10"),
        ["thousands", "large amount", "substantial", "significant loss", "life savings",
         "retirement", "mortgage payment", "foreclosure", "garnishment", "bankruptcy",
         "wage"],
    ),
}

# Tier label and the score at which it starts, highest first.
TIERS = [
    ("Critical", Decimal("0.65")),
    ("High", Decimal("0.40")),
    ("Medium", Decimal("0.20")),
    ("Low", Decimal("0.00")),
]

# Explanation texts.
NO_TEXT = "No text provided. Defaulted to Low severity."
NO_SIGNAL = "No high-risk keywords detected. Routine handling."
