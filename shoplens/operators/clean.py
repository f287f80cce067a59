"""Clean layer: join the seven raw tables into the flat ``orders_clean`` fact.

Plan shape (what Catalyst sees):

* payments and reviews are aggregated to one row per order *before* they
  are joined (A1, A2) so the fact never multiplies;
* customers join the orders and products join the items (AQE broadcasts a
  dimension whose runtime size is under the threshold, keeps a sort-merge
  join otherwise, and splits a hot customer / product on the big side);
* payments and reviews meet the order rows, of which there are far fewer than
  items; then order rows ⋈ item rows, the only join as large as the fact;
* an order that holds a large part of all items (a heavy hitter, found by a
  mergeable frequency sketch) is joined by (order, salt): its items are dealt
  by product over ``SALTS`` tasks and its one order row is repeated for each. The
  salt follows from order and product;
* the review median is a one-row aggregate attached by a broadcast cross
  join of that single row; it is taken over one row an order, weighted by the
  order's items, so that the item join is not done twice;
* de-duplication is an aggregate that keeps the smallest (price,
  freight_value, ...) row of each key. It works on either side of the last join,
  on narrow rows: of a key's joined rows, which are all pairs of its item rows and its
  order rows, the smallest one is the pair of the smallest item row and the
  smallest order row. The aggregate of the items sorts as the join needs them,
  so that the wide joined rows are neither sorted nor grouped again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.functions.numeric import half_even, to_money, try_double
from shoplens.schema import (
    ADVANCED_COLUMNS,
    ADVANCED_UNKNOWN,
    CLEAN_COLUMNS,
    DEDUP_COLUMNS,
    LABEL_COLUMNS,
    MONEY_COLUMNS,
    PIPELINE_UNKNOWN,
)


# ---- A1 / A2 -----------------------------------------------------------------

def payments_per_order(payments: DataFrame) -> DataFrame:
    """A1: total payment per order (DECIMAL, exact)."""
    return (payments.groupBy("order_id")
            .agg(F.sum(to_money("payment_value")).alias("payment_value")))


def reviews_per_order(reviews: DataFrame) -> DataFrame:
    """A2: mean review score per order, rounded half-even to a whole number."""
    return (reviews.groupBy("order_id")
            .agg(half_even(F.avg(try_double("review_score")), 0).alias("review_score")))


# ---- J1..J6 ------------------------------------------------------------------

def translate_products(products: DataFrame, translations: DataFrame) -> DataFrame:
    """Products ⟕ translations on the raw category name."""
    tr = (translations.where(F.col("product_category_name").isNotNull())
          .select("product_category_name", "product_category_name_english"))
    return products.join(tr, "product_category_name", "left").select(
        "product_id", "product_category_name_english")


def join_sources(raw: dict[str, DataFrame], unique: bool = False) -> DataFrame:
    """J2..J6: the unified, not yet cleaned, order-item rows; with ``unique`` one
    row a key (P7, and P2, P3, P5 of the columns that decide which row stays).

    Same rows as ``orders ⋈ items ⟕ products ⟕ payments ⟕ reviews ⟕
    customers`` (left joins on one side's key commute with the inner join),
    ordered so each dimension meets the smaller table it belongs to:
    customers and the two order-level aggregates join the orders, products
    the items. The last shuffle of the fact is on ``order_id`` and ``_salt``
    (0 but for heavy orders). A hot customer or product only skews a join
    whose output is re-shuffled anyway (AQE can split it without adding an
    exchange).
    """
    customers = raw["customers"].select("customer_id", "customer_city", "customer_state")
    orders = (raw["orders"].select("order_id", "customer_id", "order_purchase_timestamp")
              .join(customers, "customer_id", "left"))
    products = translate_products(raw["products"], raw["translations"])
    items = (raw["order_items"].select("order_id", "product_id", "price", "freight_value")
             .join(products, "product_id", "left"))
    pay = payments_per_order(raw["payments"])
    rev = reviews_per_order(raw["reviews"])
    orders = orders.join(pay, "order_id", "left").join(rev, "order_id", "left")
    hot = F.broadcast(hot_orders(raw["order_items"]))  # HOT_ORDERS rows at most
    dealt = F.when(F.col("_hot"), F.pmod(F.xxhash64("product_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    items = items.join(hot, "order_id", "left").withColumn("_salt", dealt).drop("_hot")
    if unique:
        orders = dedup_orders(_ranked(orders, [], ["customer_city", "customer_state"]), ORDER_KEYS)
    orders = orders.join(hot, "order_id", "left").withColumn("_salt", F.explode(every)).drop("_hot")
    if unique:
        items = _ranked(items, ["price", "freight_value"], ["product_category_name_english"])
        items = dedup_orders(items.repartition("order_id", "_salt"), ["order_id", "_salt", "product_id"])
    return orders.join(items, ["order_id", "_salt"], "inner")


#: an order row's part of the de-duplication key; the item's is its product
ORDER_KEYS = ["order_id", "customer_id", "order_purchase_timestamp"]


def _ranked(side: DataFrame, money: list[str], labels: list[str]) -> DataFrame:
    """Rows of one side of the last join that have its keys, with comparable values."""
    keys = [c for c in (*ORDER_KEYS, "product_id") if c in side.columns]
    if ORDER_KEYS[-1] in keys:
        side = parse_dates(side, ORDER_KEYS[-1])
    return side.dropna(subset=keys).withColumns({c: to_money(c) for c in money}).fillna(PIPELINE_UNKNOWN, subset=labels)


#: orders that may be dealt over several tasks, the share of all items from which one is, and its tasks
HOT_ORDERS, HOT_SHARE, SALTS = 1000, 1 / 1000, 256


def hot_orders(items: DataFrame) -> DataFrame:
    """(order_id, _hot): orders that hold ``HOT_SHARE`` of all items or more.

    From a frequent-items sketch, which merges over partitions: one pass over
    one column, no shuffle of it. It never misses an order of that share (it tracks
    20 times as many), may name one a little smaller, and yields
    ``HOT_ORDERS`` rows at most."""
    tops = items.select("order_id").agg(F.expr(f"approx_top_k(order_id, {HOT_ORDERS}, {20 * HOT_ORDERS})").alias("top"),
                                        F.count("order_id").alias("n"))
    # tiny tables have no task that is too long
    return (tops.where(F.col("n") >= 10 * HOT_ORDERS).select("n", F.explode("top").alias("t"))
            .where((F.col("t.count") >= F.col("n") * F.lit(HOT_SHARE)) & F.col("t.item").isNotNull())
            .select(F.col("t.item").alias("order_id"), F.lit(True).alias("_hot")))


# ---- P1..P7 ------------------------------------------------------------------

def project_clean(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename two columns, keep the eleven clean columns (and ``keep``), error on missing ones."""
    renamed = df.withColumnsRenamed({
        "order_purchase_timestamp": "order_date",
        "product_category_name_english": "product_category_name",
    })
    missing = [c for c in CLEAN_COLUMNS if c not in renamed.columns]
    if missing:
        raise ValueError(f"the joined sources lack {missing}")
    return renamed.select(*CLEAN_COLUMNS, *keep)


def to_timestamp_ntz(c: str, dtype: T.DataType) -> Column:
    """Text/date/timestamp -> TIMESTAMP_NTZ; unparseable -> NULL."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.col(c)
    if isinstance(dtype, T.StringType):
        return F.col(c).try_cast(T.TimestampNTZType())
    return F.col(c).cast(T.TimestampNTZType())


def parse_dates(df: DataFrame, column: str = "order_date") -> DataFrame:
    """Parse order timestamps without raising."""
    return df.withColumn(column, to_timestamp_ntz(column, df.schema[column].dataType))


def coerce_money(df: DataFrame) -> DataFrame:
    """Money columns -> DECIMAL(18,2); no number / NULL -> 0, out of range raises."""
    return df.withColumns({c: to_money(c) for c in MONEY_COLUMNS})


def _times(dimension: DataFrame, key: str) -> DataFrame | None:
    """(key, times) of keys that a dimension holds more than once; None if there are none."""
    times = dimension.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return None if times.limit(1).count() == 0 else times


def _weighted(rows: DataFrame, weight: str, dimension: DataFrame, key: str) -> DataFrame:
    """``weight`` times the rows that a left join with ``dimension`` makes of each row."""
    times = _times(dimension, key)
    if times is None:
        return rows
    return rows.join(times, key, "left").withColumn(weight, F.col(weight) * F.coalesce("times", F.lit(1))).drop("times")


def review_median(raw: dict[str, DataFrame]) -> DataFrame:
    """The median review score over all joined rows (one row, ``_median``).

    The score belongs to the order, so each order counts as often as the joins
    repeat it: its item rows, times the rows that its dimensions hold for a key
    (dimension keys are counted; a dimension with unique keys is not joined).
    """
    items = raw["order_items"].select("order_id", "product_id", F.lit(1).alias("n"))
    items = _weighted(items, "n", translate_products(raw["products"], raw["translations"]), "product_id")
    orders = raw["orders"].select("order_id", "customer_id", F.lit(1).alias("m"))
    orders = _weighted(orders, "m", raw["customers"], "customer_id")
    per_order = (orders.groupBy("order_id").agg(F.sum("m").alias("m"))
                 .join(items.groupBy("order_id").agg(F.sum("n").alias("n")), "order_id")
                 .join(reviews_per_order(raw["reviews"]), "order_id"))
    return per_order.agg(F.expr("percentile(review_score, 0.5, m * n)").alias("_median"))


def impute_review_score(df: DataFrame, med: DataFrame | None = None) -> DataFrame:
    """NULL score -> exact median of all rows (0 if all NULL), half-even, INT.

    ``med`` is the one-row median if the caller has it; a median keeps a
    value->count map, so with a handful of distinct scores it stays tiny.
    """
    scored = df.withColumn("review_score", try_double("review_score"))
    if med is None:
        med = scored.agg(F.median("review_score").alias("_median"))
    return (scored.crossJoin(F.broadcast(med))  # exactly one row
            .withColumn("review_score",
                        half_even(F.coalesce(F.col("review_score"), F.col("_median"), F.lit(0.0)), 0)
                        .cast("int"))
            .drop("_median"))


def fill_unknown(df: DataFrame, label: str = PIPELINE_UNKNOWN) -> DataFrame:
    """P5: NULL category / city / state -> "unknown"."""
    return df.fillna(label, subset=LABEL_COLUMNS)


def drop_null_keys(df: DataFrame) -> DataFrame:
    """Rows need order, customer, product and date."""
    return df.dropna(subset=DEDUP_COLUMNS)


def dedup_orders(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per key; the survivor is the smallest (price, freight, ...).

    An aggregate with a partial step rather than a window, so a hot key is
    combined on the map side (Spark sorts for a minimum of structs).
    """
    keys = keys or DEDUP_COLUMNS
    rest = [c for c in df.columns if c not in keys]
    pick = F.min(F.struct(*[F.col(c) for c in rest])).alias("_keep")
    return (df.groupBy(*keys).agg(pick)
            .select(*keys, *[F.col(f"_keep.{c}").alias(c) for c in rest])
            .select(*df.columns))


def build_orders_clean(raw: dict[str, DataFrame]) -> DataFrame:
    """The whole clean step (J1..J6, A1, A2, P1..P7)."""
    df = project_clean(join_sources(raw, unique=True))
    df = parse_dates(df)
    df = coerce_money(df)
    df = impute_review_score(df, review_median(raw))
    df = fill_unknown(df)
    return drop_null_keys(df)


# ---- P8 / P9 -------------------------------------------------------------------

def prepare_batch(batch: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Load-side cleaning of one batch: NULL score -> 0, fractional -> truncated.
    ``keep`` names extra columns carried through unchanged (e.g. the batch index)."""
    missing = [c for c in CLEAN_COLUMNS if c not in batch.columns]
    if missing:
        raise ValueError(f"a batch needs the columns {missing}")
    df = parse_dates(batch.select(*CLEAN_COLUMNS, *keep))
    df = df.dropna(subset=["order_date", "order_id", "customer_id", "product_id"])
    df = coerce_money(df)
    df = df.withColumn("review_score",
                       F.coalesce(try_double("review_score"), F.lit(0.0)).cast("int"))
    return fill_unknown(df).select(*CLEAN_COLUMNS, *keep)


def prepare_orders(df: DataFrame) -> DataFrame:
    """The analytics layer's own cleaning (note the capitalised "Unknown").

    Adds missing columns as NULL, coerces, drops rows without a date and
    rows whose customer is unknown, and keeps seven columns.
    """
    for c in ADVANCED_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    df = parse_dates(df)
    return (df.withColumns({
                "payment_value": to_money("payment_value"),
                "review_score": try_double("review_score"),
                "product_category_name": F.coalesce(F.col("product_category_name").cast("string"),
                                                    F.lit(ADVANCED_UNKNOWN)),
                "customer_state": F.coalesce(F.col("customer_state").cast("string"), F.lit(ADVANCED_UNKNOWN)),
                "customer_id": F.coalesce(F.col("customer_id").cast("string"), F.lit(ADVANCED_UNKNOWN)),
                "order_id": F.coalesce(F.col("order_id").cast("string"), F.lit("")),
            })
            .where(F.col("order_date").isNotNull() & (F.col("customer_id") != ADVANCED_UNKNOWN))
            .select(*ADVANCED_COLUMNS))
