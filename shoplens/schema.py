"""Schemas, key lists and fixed values.

FIXED VALUES: the names, labels, thresholds and model settings below must
equal the ones of the application whose behaviour we reproduce, otherwise
results differ. They are stated plainly, in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- FIXED VALUES ---------------------------------------------------------

# raw source tables and their default file names
RAW_FILES = {
    "orders": "olist_orders_dataset.csv",
    "order_items": "olist_order_items_dataset.csv",
    "payments": "olist_order_payments_dataset.csv",
    "reviews": "olist_order_reviews_dataset.csv",
    "products": "olist_products_dataset.csv",
    "customers": "olist_customers_dataset.csv",
    "translations": "product_category_name_translation.csv",
}

# the flat fact table, in this column order
CLEAN_COLUMNS = [
    "order_id",
    "customer_id",
    "product_id",
    "order_date",
    "price",
    "freight_value",
    "payment_value",
    "review_score",
    "product_category_name",
    "customer_city",
    "customer_state",
]

# table primary key (also the upsert conflict key and the validator key)
PK_COLUMNS = ["order_id", "product_id", "order_date"]
# the clean step de-duplicates on four columns
DEDUP_COLUMNS = ["order_id", "customer_id", "product_id", "order_date"]

MONEY_COLUMNS = ["price", "freight_value", "payment_value"]
LABEL_COLUMNS = ["product_category_name", "customer_city", "customer_state"]

# missing-label fill values: pipeline vs. advanced layer (kept distinct)
PIPELINE_UNKNOWN = "unknown"
ADVANCED_UNKNOWN = "Unknown"

# the advanced-analytics column subset
ADVANCED_COLUMNS = [
    "order_id",
    "customer_id",
    "order_date",
    "payment_value",
    "product_category_name",
    "customer_state",
    "review_score",
]

# forecasting feature order
FEATURE_COLUMNS = [
    "day_of_week",
    "day_of_month",
    "month",
    "quarter",
    "is_weekend",
    "lag_1",
    "lag_2",
    "lag_3",
    "lag_7",
    "rolling_mean_3",
    "rolling_mean_7",
    "rolling_mean_14",
    "rolling_std_7",
    "revenue_change_1",
]
TARGET_COLUMN = "daily_revenue"
LAGS = [1, 2, 3, 7]
ROLLING_MEANS = [3, 7, 14]
ROLLING_STD_WINDOW = 7

# boosted-tree settings
MODEL_SETTINGS = {
    "n_trees": 160,
    "max_depth": 3,
    "learning_rate": 0.05,
    "row_sample": 0.9,
    "column_sample": 0.9,
    "seed": 42,
}
TRAIN_FRACTION = 0.8
MIN_ROWS_FOR_SPLIT = 5
TOP_DRIVERS = 5

Z_THRESHOLD = 2.5
CHURN_WINDOW_DAYS = 30
DEFAULT_BATCH_SIZE = 1000
LTV_DEFAULT_LIMIT = 10

SEGMENT_ORDER = ["High", "Medium", "Low"]
WEEKDAY_LABELS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]

# rule texts
INSIGHT_TREND_UP = "Revenue is trending upward 📈"
INSIGHT_TREND_DOWN = "Revenue is trending downward ⚠️"
INSIGHT_TREND_STABLE = "Revenue is broadly stable"
INSIGHT_WEEKEND = "Weekend sales are higher than weekday sales"
INSIGHT_WEEKDAY = "Weekday sales outperform weekends"
INSIGHT_LARGEST_SHARE = "{} contributes the largest revenue share"
INSIGHT_TOP_CATEGORY = "{} is the top revenue category"
INSIGHT_ANOMALIES = "{} revenue anomalies need review ⚠️"
TOP_SHARE_THRESHOLD = 0.25
UNKNOWN_TOP_CATEGORY = "Unknown"

RECO_WEEKEND = "Focus promotions and ad spend on weekends"
RECO_WEEKDAY = "Prioritize weekday campaigns and operational coverage"
RECO_CATEGORY = "Expand inventory and merchandising around top-performing categories"
RECO_ANOMALY = "Investigate revenue anomalies before scaling campaigns"
RECO_DOWN = "Review recent pricing, stock availability, and campaign performance"
RECO_UP = "Protect current growth by monitoring fulfillment capacity and stock levels"
RECO_FALLBACK = "Continue monitoring revenue, category mix, and anomaly signals"

# substrings the recommendation rules look for in the lower-cased insights
MATCH_WEEKEND = "weekend sales are higher"
MATCH_WEEKDAY = "weekday sales outperform"
MATCH_TOP_CATEGORY = "top revenue category"
MATCH_LARGEST_SHARE = "largest revenue share"
MATCH_ANOMALIES = "anomalies need review"
MATCH_DOWN = "trending downward"
MATCH_UP = "trending upward"

# retention colour bands (lower bounds, percent)
RETENTION_BANDS = [(75, "very_high"), (50, "high"), (25, "medium"), (0, "low")]

# ---- schemas ----------------------------------------------------------------

# wide enough for an order of 10^15; sums of it are DECIMAL(28,2)
MONEY = T.DecimalType(18, 2)

CLEAN_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType(), False),
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("product_id", T.StringType(), False),
    T.StructField("order_date", T.TimestampNTZType(), False),
    T.StructField("price", MONEY, False),
    T.StructField("freight_value", MONEY, False),
    T.StructField("payment_value", MONEY, False),
    T.StructField("review_score", T.IntegerType(), False),
    T.StructField("product_category_name", T.StringType(), False),
    T.StructField("customer_city", T.StringType(), False),
    T.StructField("customer_state", T.StringType(), False),
])

# raw tables: the columns the clean step touches (CSV headers may hold more)
RAW_REQUIRED_COLUMNS = {
    "orders": ["order_id", "customer_id", "order_purchase_timestamp"],
    "order_items": ["order_id", "product_id", "price", "freight_value"],
    "payments": ["order_id", "payment_value"],
    "reviews": ["order_id", "review_score"],
    "products": ["product_id", "product_category_name"],
    "customers": ["customer_id", "customer_city", "customer_state"],
    "translations": ["product_category_name", "product_category_name_english"],
}
