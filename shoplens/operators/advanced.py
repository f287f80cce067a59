"""Customer analytics (A16..A20, J9..J11) over the analytics-layer rows.

Every operator pre-aggregates before it shuffles on a customer or an order:

* cohorts work on distinct (customer, month) pairs, so a customer with a
  third of all rows contributes at most one row per month;
* churn / LTV first group by (customer, order) — a shuffle on the pair,
  which spreads a hot customer — then by customer with map-side combine;
  distinct order counts fall out of the first step exactly;
* root cause works on the (day), (day, category) and (day, state)
  aggregates, all produced by one GROUPING SETS pass over the fact.

Global scalars of the fact (max date, span midpoint) are one-row aggregates
attached with a broadcast cross join; scalars of the small derived tables
(max cohort period, per-day z-scores of the root-cause cube) are windows
over those calendar-bounded tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.dates import day, month_label, month_start, months_between_periods, whole_days
from shoplens.functions.numeric import half_even, pct_increase
from shoplens.operators.signals import zscore_days
from shoplens.session import materialize
from shoplens.schema import CHURN_WINDOW_DAYS, LTV_DEFAULT_LIMIT, Z_THRESHOLD


# ---- A16 cohort retention ---------------------------------------------------------

def customer_months(orders: DataFrame) -> DataFrame:
    """Distinct (customer, month) activity pairs."""
    return orders.select("customer_id", month_start("order_date").alias("order_month")).distinct()


def cohort_activity(orders: DataFrame) -> DataFrame:
    """(cohort_month, period_number, active_customers, cohort_size, retention_pct).

    One linear pipeline: distinct (customer, month) pairs, the customer's
    first month by a window over those pairs (a customer has at most one
    row per month, so even a very hot customer is a small window), counts
    per (cohort, period). Every customer is active in period 0 of its own
    cohort, so the cohort size is the period-0 count.
    """
    cm = customer_months(orders)
    first = F.min("order_month").over(Window.partitionBy("customer_id"))
    active = (cm.withColumn("cohort_month", first)
              .withColumn("period_number", months_between_periods("order_month", "cohort_month"))
              .groupBy("cohort_month", "period_number")
              .agg(F.count(F.lit(1)).alias("active_customers")))
    # the remaining windows run over (cohort x period) rows: bounded by months squared
    size = F.max(F.when(F.col("period_number") == 0, F.col("active_customers"))).over(
        Window.partitionBy("cohort_month"))
    return (active.withColumn("cohort_size", F.coalesce(size, F.lit(0)))
            .withColumn("retention_pct",
                        F.when(F.col("cohort_size") > 0,
                               F.col("active_customers").cast("double") / F.col("cohort_size") * 100.0)
                        .otherwise(F.lit(0.0))))


def cohort_retention(orders: DataFrame, rounded: bool = True) -> DataFrame:
    """A16, API form: one row per cohort with the dense retention array over
    periods 0 .. global max period, 0-filled, period 0 forced to 100.0,
    values rounded half-even to 2 places."""
    act = cohort_activity(orders).withColumn(
        "_max", F.max("period_number").over(Window.partitionBy()))  # small table, see above
    by_cohort = (act.groupBy("cohort_month")
                 .agg(F.map_from_entries(F.collect_list(F.struct("period_number", "retention_pct"))).alias("_m"),
                      F.max("_max").alias("_max")))

    def cell(p):
        v = F.coalesce(F.element_at(F.col("_m"), p), F.lit(0.0))
        return F.when(p == 0, F.lit(100.0)).otherwise(half_even(v, 2) if rounded else v)

    dense = F.transform(F.sequence(F.lit(0), F.col("_max")), cell)
    return (by_cohort.select(month_label("cohort_month").alias("cohort_month"), dense.alias("retention"))
            .orderBy("cohort_month"))


def cohort_retention_long(orders: DataFrame, rounded: bool = True) -> DataFrame:
    """A16, long form: (cohort_month, period_number, retention_pct)."""
    return (cohort_retention(orders, rounded)
            .select("cohort_month", F.posexplode("retention").alias("period_number", "retention_pct"))
            .withColumn("period_number", F.col("period_number").cast("int"))
            .orderBy("cohort_month", "period_number"))


# ---- A17 revenue decomposition ------------------------------------------------------

def _zeros_if(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(0.0)).otherwise(value)


def revenue_decomposition(orders: DataFrame) -> DataFrame:
    """Split the span at its time midpoint (<= midpoint is "previous").

    order effect = (n1 - n0) * aov0, AOV effect = n1 * (aov1 - aov0), both and
    the total change as % of previous revenue; zeros for an empty half or a
    zero base. The midpoint test is done in integer microseconds
    (2*(t - start) <= end - start), so no half-microsecond is lost.
    """
    bounds = orders.agg(F.min("order_date").alias("_start"), F.max("order_date").alias("_end"))
    t = orders.crossJoin(F.broadcast(bounds))
    is_prev = (2 * F.timestamp_diff("MICROSECOND", F.col("_start"), F.col("order_date"))
               <= F.timestamp_diff("MICROSECOND", F.col("_start"), F.col("_end")))
    per_order = (t.withColumn("_prev", is_prev)
                 .groupBy("order_id")
                 .agg(F.max(F.col("_prev").cast("int")).alias("has_prev"),
                      F.max((~F.col("_prev")).cast("int")).alias("has_cur"),
                      F.sum(F.when(F.col("_prev"), F.col("payment_value"))).alias("rev_prev"),
                      F.sum(F.when(~F.col("_prev"), F.col("payment_value"))).alias("rev_cur")))
    tot = per_order.agg(
        F.coalesce(F.sum("has_prev"), F.lit(0)).alias("prev_order_count"),
        F.coalesce(F.sum("has_cur"), F.lit(0)).alias("cur_order_count"),
        F.coalesce(F.sum("rev_prev"), F.lit(0)).cast("double").alias("previous_revenue"),
        F.coalesce(F.sum("rev_cur"), F.lit(0)).cast("double").alias("current_revenue"))
    n0 = F.greatest(F.col("prev_order_count"), F.lit(1)).cast("double")
    n1 = F.greatest(F.col("cur_order_count"), F.lit(1)).cast("double")
    r0, r1 = F.col("previous_revenue"), F.col("current_revenue")
    aov0, aov1 = r0 / n0, r1 / n1
    empty = (F.col("prev_order_count") == 0) | (F.col("cur_order_count") == 0) | (r0 == 0)
    return tot.select(
        _zeros_if(empty, half_even((r1 - r0) / r0 * 100.0, 2)).alias("total_change_pct"),
        _zeros_if(empty, half_even((n1 - n0) * aov0 / r0 * 100.0, 2)).alias("order_contribution_pct"),
        _zeros_if(empty, half_even(n1 * (aov1 - aov0) / r0 * 100.0, 2)).alias("aov_contribution_pct"),
        "previous_revenue", "current_revenue",
        F.col("prev_order_count").cast("bigint").alias("previous_orders"),
        F.col("cur_order_count").cast("bigint").alias("current_orders"))


# ---- A18 churn risk -------------------------------------------------------------------

def churn_customers(orders: DataFrame, window_days: int = CHURN_WINDOW_DAYS) -> DataFrame:
    """Per customer: recency, totals and the two activity windows, with the risk flag.

    Windows: current = (cut, +inf), previous = (prior, cut], where
    cut = max date - N days and prior = cut - N days. J11's two left joins
    become one conditional aggregation.
    """
    bounds = orders.agg(F.max("order_date").alias("analysis_date"))
    t = (orders.crossJoin(F.broadcast(bounds))
         .withColumn("_cut", F.col("analysis_date") - F.expr(f"INTERVAL {int(window_days)} DAYS"))
         .withColumn("_prior", F.col("_cut") - F.expr(f"INTERVAL {int(window_days)} DAYS")))
    cur = F.col("order_date") > F.col("_cut")
    prev = (F.col("order_date") > F.col("_prior")) & (F.col("order_date") <= F.col("_cut"))
    per_order = (t.groupBy("customer_id", "order_id")
                 .agg(F.max("order_date").alias("last_date"),
                      F.first("analysis_date").alias("analysis_date"),
                      F.sum("payment_value").alias("spend"),
                      F.max(cur.cast("int")).alias("in_cur"),
                      F.max(prev.cast("int")).alias("in_prev"),
                      F.sum(F.when(cur, F.col("payment_value"))).alias("spend_cur"),
                      F.sum(F.when(prev, F.col("payment_value"))).alias("spend_prev")))
    cust = (per_order.groupBy("customer_id")
            .agg(F.max("last_date").alias("last_order_date"),
                 F.first("analysis_date").alias("analysis_date"),
                 F.sum("spend").alias("total_spent"),
                 F.count(F.lit(1)).alias("total_orders"),
                 F.sum("in_cur").alias("current_orders"),
                 F.sum("in_prev").alias("previous_orders"),
                 F.coalesce(F.sum("spend_cur"), F.lit(0)).alias("current_spend"),
                 F.coalesce(F.sum("spend_prev"), F.lit(0)).alias("previous_spend")))
    days = whole_days("last_order_date", "analysis_date")
    aov = F.when(F.col("total_orders") > 0,
                 F.col("total_spent").cast("double") / F.col("total_orders")).otherwise(F.lit(0.0))
    risky = (days > window_days) & ((F.col("current_orders") < F.col("previous_orders"))
                                    | (F.col("current_spend") < F.col("previous_spend")))
    return cust.select(
        "customer_id", "last_order_date",
        days.alias("days_since_last_purchase"),
        F.col("total_spent").cast("double").alias("total_spent"),
        F.col("total_orders").cast("bigint").alias("total_orders"),
        F.col("current_orders").cast("bigint").alias("current_orders"),
        F.col("previous_orders").cast("bigint").alias("previous_orders"),
        F.col("current_spend").cast("double").alias("current_spend"),
        F.col("previous_spend").cast("double").alias("previous_spend"),
        risky.alias("is_high_risk"),
        aov.alias("avg_order_value"),
        F.greatest(F.col("previous_spend").cast("double"), aov).alias("potential_loss"))


def churn_risk(orders: DataFrame, window_days: int = CHURN_WINDOW_DAYS) -> DataFrame:
    """Count of high-risk customers and the summed potential loss (2 places)."""
    risky = churn_customers(orders, window_days).where("is_high_risk")
    return risky.agg(
        F.count(F.lit(1)).cast("bigint").alias("high_risk_customers"),
        # each customer's loss as a decimal: the sum doesn't depend on the order of rows
        half_even(F.coalesce(F.sum(F.col("potential_loss").cast("decimal(28,6)")).cast("double"), F.lit(0.0)), 2)
        .alias("potential_revenue_loss"))


# ---- A19 customer lifetime value -----------------------------------------------------------

def customer_value(orders: DataFrame) -> DataFrame:
    """Per-customer LTV components: LTV = AOV x frequency x active days."""
    per_order = (orders.groupBy("customer_id", "order_id")
                 .agg(F.sum("payment_value").alias("spend"),
                      F.min("order_date").alias("first_date"),
                      F.max("order_date").alias("last_date")))
    cust = (per_order.groupBy("customer_id")
            .agg(F.sum("spend").cast("double").alias("total_spent"),
                 F.count(F.lit(1)).cast("bigint").alias("total_orders"),
                 F.min("first_date").alias("first_order_date"),
                 F.max("last_date").alias("last_order_date")))
    active = F.greatest(whole_days("first_order_date", "last_order_date"), F.lit(1))
    return (cust.withColumn("active_days", active.cast("bigint"))
            .withColumn("avg_order_value", F.when(F.col("total_orders") > 0,
                                                  F.col("total_spent") / F.col("total_orders"))
                        .otherwise(F.lit(0.0)))
            .withColumn("purchase_frequency", F.when(F.col("active_days") > 0,
                                                     F.col("total_orders") / F.col("active_days"))
                        .otherwise(F.lit(0.0)))
            .withColumn("lifespan_days", F.col("active_days"))
            .withColumn("ltv", F.col("avg_order_value") * F.col("purchase_frequency") * F.col("lifespan_days")))


def customer_ltv(orders: DataFrame, limit: int = LTV_DEFAULT_LIMIT) -> DataFrame:
    """Top customers by LTV (distributed top-k; ties by customer id)."""
    k = max(int(limit), 1)
    return (customer_value(orders)
            .orderBy(F.desc("ltv"), F.asc("customer_id")).limit(k)
            .select("customer_id", half_even("ltv", 2).alias("ltv"),
                    "total_spent", "total_orders", "active_days", "avg_order_value", "purchase_frequency"))


# ---- A20 anomaly root cause -------------------------------------------------------------------

# grouping_id of each grouping set over (order_day, category, state):
# a bit is set for each column the set aggregates away
_GID_DAY, _GID_DAY_CATEGORY, _GID_DAY_STATE = 3, 1, 2


def day_revenue_cube(orders: DataFrame) -> DataFrame:
    """Revenue per day, per (day, category) and per (day, state) from ONE scan
    of the fact (``GROUPING SETS``: Expand + map-side partial aggregation)."""
    base = orders.select(day("order_date").alias("order_day"), "product_category_name", "customer_state",
                         "payment_value")
    return (base.groupingSets([["order_day"], ["order_day", "product_category_name"],
                               ["order_day", "customer_state"]],
                              "order_day", "product_category_name", "customer_state")
            .agg(F.sum("payment_value").alias("rev"), F.grouping_id().alias("_gid")))


def observed_anomaly_days(orders: DataFrame, z: float = Z_THRESHOLD) -> DataFrame:
    """Observed days (not the gap-filled calendar) with |z| > threshold — the
    day set ``anomaly_root_cause`` explains by default (it computes the same
    z-scores inside its single pass)."""
    daily = (orders.groupBy(day("order_date").alias("order_day"))
             .agg(F.sum("payment_value").alias("revenue")))
    return zscore_days(daily).where(F.abs("z_score") > z).select("order_day")


def anomaly_root_cause(orders: DataFrame, dates: list[str] | None = None, z: float = Z_THRESHOLD,
                       anomaly_days: DataFrame | None = None) -> DataFrame:
    """Per anomaly day, the top category and state and their % increase
    over their own baseline (NULL when that label sold on no other day).

    Days come from ``dates`` (normalised to calendar days), ``anomaly_days``
    (a DataFrame with ``order_day``) or the observed-day z-score detector.
    Days without orders, or when no other day exists, are skipped.

    The fact is scanned once: ``day_revenue_cube`` (days x labels rows) is
    written, and read for the day z-scores, each label's total and number of
    sales days, and each day's best label (ties -> smallest label). These are
    aggregates with a partial step, so no task holds the (day, label) rows.
    The baseline of a label is the mean over its *other* sales days:
    (total - day) / (n - 1).
    """
    cube = materialize(day_revenue_cube(orders), "day_cube")
    days = cube.where(F.col("_gid") == _GID_DAY).select("order_day", F.col("rev").alias("revenue"))
    if anomaly_days is not None:
        chosen = anomaly_days.select(F.col("order_day").cast("date").alias("order_day"))
    elif dates:
        chosen = (orders.sparkSession.createDataFrame([(d,) for d in dates], "d string")
                  .select(F.to_date(F.col("d").try_cast("timestamp_ntz")).alias("order_day")))
    else:
        chosen = zscore_days(days).where(F.abs("z_score") > z).select("order_day")
    several = days.agg(F.count(F.lit(1)).alias("_days")).where("_days > 1")  # one row or none
    chosen = chosen.distinct().crossJoin(F.broadcast(several)).select("order_day")

    is_cat = F.col("_gid") == _GID_DAY_CATEGORY
    labels = cube.where(F.col("_gid") != _GID_DAY).select(
        "_gid", "order_day", F.when(is_cat, F.col("product_category_name")).otherwise(F.col("customer_state")).alias("label"),
        "rev")
    totals = labels.groupBy("_gid", "label").agg(F.sum("rev").alias("_sum"), F.count(F.lit(1)).alias("_ndays"))
    best = (labels.join(chosen, "order_day", "left_semi").groupBy("_gid", "order_day")
            .agg(F.min(F.struct((-F.col("rev")).alias("minus"), F.col("label"))).alias("b"))
            .select("_gid", "order_day", F.col("b.label").alias("label"), (-F.col("b.minus")).alias("rev")))
    # a label may be NULL: match it with itself
    t = totals.select(F.col("_gid").alias("_g"), F.col("label").alias("_l"), "_sum", "_ndays")
    found = best.join(t, (F.col("_gid") == F.col("_g")) & F.col("label").eqNullSafe(F.col("_l")))
    baseline = F.when(F.col("_ndays") > 1, (F.col("_sum") - F.col("rev")).cast("double") / (F.col("_ndays") - 1))
    pct = half_even(pct_increase(F.col("rev"), baseline), 2)
    return (found.groupBy("order_day")
            .agg(F.max(F.when(is_cat, F.col("label"))).alias("top_category"),
                 F.max(F.when(is_cat, pct)).alias("category_increase_pct"),
                 F.max(F.when(~is_cat, F.col("label"))).alias("top_state"),
                 F.max(F.when(~is_cat, pct)).alias("state_increase_pct"))
            .select(F.col("order_day").alias("date"), "top_category", "category_increase_pct",
                    "top_state", "state_increase_pct")
            .orderBy("date"))
