"""Word lists, formats and constants that decide results."""

# Cell texts that mean "no value" (compared in lower case, trimmed).
PLACEHOLDERS = ["unknown", "na", "n/a", "null", "none", "-", "--", "", "nan", "undefined", "nil", "n.a.", "?"]

# Canonical categories and their known spellings.
CANONICAL = {
    "region": ["North", "South", "East", "West", "Central"],
    "category": ["Electronics", "Clothing", "Furniture", "Groceries", "Toys", "Beauty"],
    "payment_method": ["Credit Card", "Debit Card", "UPI", "Net Banking", "Cash"],
    "order_status": ["Delivered", "Shipped", "Processing", "Cancelled", "Refunded"],
}
ALIASES = {
    "region": {
        "North": ["n.", "nort", "n", "north"],
        "South": ["s.", "suth", "s", "south"],
        "East": ["e.", "est", "e", "east"],
        "West": ["w.", "wst", "w", "west"],
        "Central": ["c.", "centeral", "cntral", "c", "central"],
    },
    "category": {
        "Electronics": ["electroncs", "electronic", "electronics"],
        "Clothing": ["clothng", "cloths", "clothing"],
        "Furniture": ["furnture", "furniture"],
        "Groceries": ["grocry", "grocery", "groceries"],
        "Toys": ["toy", "toys"],
        "Beauty": ["beuty", "beauty"],
    },
    "payment_method": {
        "Credit Card": ["credit card"],
        "Debit Card": ["debit card"],
        "UPI": ["upi"],
        "Net Banking": ["net banking", "netbanking"],
        "Cash": ["cash"],
    },
    "order_status": {},
}
FUZZY_CUTOFF = 60.0

# Date layouts, year-first ones before day-first ones.
DATE_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "yyyyMMdd",
    "dd/MM/yyyy",
    "d/M/yyyy",
    "dd-MM-yyyy",
    "dd.MM.yyyy",
    "dd MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "MM/dd/yyyy",
]

# Business rules of the cleaning step.
DISCOUNT_CEILING = 0.99
RATING_LOW, RATING_HIGH, RATING_DEFAULT = 1.0, 5.0, 3.0
SALES_TOLERANCE, SALES_CEILING = 5.0, 100000.0

# Weights of the quality score.
SCORE_WEIGHTS = {
    "completeness": 0.35,
    "type_validity": 0.25,
    "uniqueness": 0.20,
    "consistency": 0.10,
    "accuracy": 0.10,
}

# Tier limits and labels.
REVENUE_TIERS = [
    (10000, "Tier 1 - Enterprise (>=10k)"),
    (3000, "Tier 2 - High (3k-10k)"),
    (1000, "Tier 3 - Medium (1k-3k)"),
]
REVENUE_TIER_REST = "Tier 4 - Entry (<1k)"
SATISFACTION_TIERS = [(4.0, "Positive (4-5)"), (3.0, "Neutral (3)")]
SATISFACTION_TIER_REST = "Detractor (1-2)"

# Growth clip, cost ratio and default horizon.
CAGR_FLOOR, CAGR_CEILING = -0.03, 0.06
COGS_RATIO = 0.68
DEFAULT_HORIZON = 20

# Column names that carry a business meaning.
SALES_NAMES = ["total_sales", "sales_amount", "sales", "revenue", "gross_revenue"]
QUANTITY_NAMES = ["quantity", "qty", "units"]
PRICE_NAMES = ["unit_price", "price", "cost_per_unit"]
TARGET_WORDS = ["revenue", "sales", "churn", "margin", "profit", "ltv", "amount"]

# Names of the operations in the audit trail, as they are shown.
AUDIT_OPERATIONS = {
    "headers": "Header Normalization",
    "placeholders": "Trimming & Null Placeholders",
    "id_suffix": "Id Suffix Removal",
    "empty_rows": "Empty Row Pruning",
    "duplicates": "Exact Deduplication",
    "key_duplicates": "Primary Key Deduplication",
    "categories": "Categorical Standardization",
    "dates": "Date Parsing & ISO Standardization",
    "quantity": "Quantity Sign & Minimum Enforcement",
    "price": "Price Currency Sanitization",
    "discount": "Discount Percentage Unification",
    "rating": "Rating Sentinel Sanitization",
    "sales": "Formula Anomaly & Outlier Correction",
    "median": "Null Imputation (Median)",
    "mode": "Null Imputation (Mode)",
    "forward_fill": "Null Imputation (Forward Fill)",
}

# Advice for the shape of a distribution, as it is shown.
TRANSFORM_ADVICE = {
    "right_skewed": "Log1p or Square Root",
    "left_skewed": "Power Transform / Square",
    "heavy_tailed": "Robust Scaling (Interquartile)",
    "zero_inflated": "Two-part hurdle model",
    "normal_like": "Standardization (Z-Score)",
}

# Vocabulary that must not appear in non-retail output.
RETAIL_TERMS = [
    "revenue", "sales", "order", "product", "aov", "cart", "customer", "profit", "price", "transactions", "payment",
]
CURRENCY_SYMBOLS = ["₹", "$", "€", "£"]
# by domain (fixed values): what must not appear in texts about it
BANNED_TERMS = {
    "demographics": RETAIL_TERMS,
    "healthcare": ["revenue", "sales", "order", "cart", "aov", "profit"],
    "finance": ["patient", "cart", "shipment"],
    "ecommerce": [],
}
BANNED_SYMBOLS = {"demographics": CURRENCY_SYMBOLS, "healthcare": CURRENCY_SYMBOLS, "finance": [], "ecommerce": []}
