"""Column names, domain rules and campaign economics, in one place."""

from pyspark.sql import types as T

# Results depend on these names and numbers, so they are stated literally.
ID = "customer_id"
LABEL = "churned"

CATEGORICAL = ["region", "device_type", "subscription_plan"]
NUMERIC = [
    "account_age_days",
    "monthly_spend",
    "num_orders_last_90d",
    "avg_order_value",
    "support_tickets_raised",
    "days_since_last_login",
    "pages_per_session",
]
DERIVED = ["recency_ratio", "is_dormant", "support_per_order"]

VALID_RANGES = {
    "account_age_days": (0, 3650),
    "monthly_spend": (0, None),
    "num_orders_last_90d": (0, None),
    "avg_order_value": (0, None),
    "support_tickets_raised": (0, None),
    "days_since_last_login": (0, 365),
    "pages_per_session": (0, None),
}

CLIPPED = ["monthly_spend", "avg_order_value"]
CLIP_LOWER = 0.01
CLIP_UPPER = 0.99
DORMANT_AFTER_DAYS = 90

# scenario -> (cost per contact, value per retained customer, uplift)
SCENARIOS = {
    "cheap_contact": (5.0, 200.0, 0.20),
    "baseline": (20.0, 200.0, 0.20),
    "expensive_offer": (50.0, 200.0, 0.20),
    "low_uplift": (20.0, 200.0, 0.10),
    "high_clv": (20.0, 500.0, 0.20),
}
DEFAULT_SCENARIO = "baseline"

SELECTION_TOLERANCE = 0.01
MODEL_PREFERENCE = ["logistic_regression", "random_forest", "hist_gradient_boosting"]

SEED = 42
HOLDOUT_SHARE = 0.2
FOLDS = 5
REPEATS = 3
BOOTSTRAP_ROUNDS = 1000
REASONS = 3
SMOKE_ROWS = 400

MISSING_LEVEL = "__MISSING__"
PSI_EPSILON = 1e-6
PSI_BINS = 10
PSI_WATCH = 0.10
PSI_INVESTIGATE = 0.20
# End of fixed values.

MODEL_NUMERIC = NUMERIC + DERIVED
RAW_FEATURES = CATEGORICAL + NUMERIC

# Fields a scoring request may leave empty; every other feature must be present.
NULLABLE_FEATURES = ["monthly_spend", "avg_order_value", "pages_per_session"]

CUSTOMER_SCHEMA = T.StructType(
    [T.StructField(ID, T.StringType())]
    + [T.StructField(c, T.StringType()) for c in CATEGORICAL]
    + [
        T.StructField("account_age_days", T.IntegerType()),
        T.StructField("monthly_spend", T.DoubleType()),
        T.StructField("num_orders_last_90d", T.IntegerType()),
        T.StructField("avg_order_value", T.DoubleType()),
        T.StructField("support_tickets_raised", T.IntegerType()),
        T.StructField("days_since_last_login", T.IntegerType()),
        T.StructField("pages_per_session", T.DoubleType()),
        T.StructField(LABEL, T.IntegerType()),
    ]
)

SCORED_SCHEMA = T.StructType(
    [
        T.StructField(ID, T.StringType()),
        T.StructField("churn_probability", T.DoubleType()),
        T.StructField("risk_tier", T.StringType()),
        T.StructField("top_reason_codes", T.StringType()),
    ]
)
