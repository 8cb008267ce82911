"""Labelled paraphrase queries for judging a retrieval index."""

# Fixed values: (query, expected category).
PARAPHRASES = [
    ("The automated teller terminal retained my paper currency without crediting my balance",
     "Retail Banking"),
    ("Third-party agency is threatening wage seizure for a disputed medical bill",
     "Debt Collection"),
    ("Inaccurate derogatory notation on my credit profile from an unknown bureau",
     "Credit Reporting"),
    ("Lender miscalculated annual percentage rate and property tax reserves",
     "Mortgages & Loans"),
    ("Merchant charged plastic line of credit twice for single transaction",
     "Credit Card"),
]

# Rationale texts of the engine choice.
DENSE_RATIONALE = (
    "Dense Sentence-Transformers chosen: Demonstrates superior semantic generalization "
    "on paraphrase queries and vocabulary mismatch while maintaining high category precision."
)
TFIDF_RATIONALE = (
    "TF-IDF chosen: Provides superior execution speed with competitive category precision."
)
