"""Product labels and the corpus split policy."""

# Product code -> business category.
CATEGORY_BY_PRODUCT = {
    "credit_card": "Credit Card",
    "credit_reporting": "Credit Reporting",
    "debt_collection": "Debt Collection",
    "mortgages_and_loans": "Mortgages & Loans",
    "retail_banking": "Retail Banking",
}
CATEGORIES = sorted(CATEGORY_BY_PRODUCT.values())

# Split ratios (validation is a share of what the test split leaves) and seed.
TEST_RATIO = 0.15
VALIDATION_RATIO = 0.15
SEED = 42
