"""Query catalogue: every operator run over the whole test tables.

Importing this module fills ``registry.QUERIES`` / ``registry.ORACLE``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.operators import clean as C
from shoplens.operators import advanced as A
from shoplens.operators import marts as M
from shoplens.operators import presentation as P
from shoplens.operators import rules as R
from shoplens.operators import signals as G
from shoplens.operators import validate as V
from shoplens.plans import bundle as BU
from shoplens.plans import forecast as FC
from shoplens.plans import timeseries as TS
from shoplens.session import materialize, remove_path, work_dir
from shoplens.sources import batches as B
from shoplens.sources.clean_store import create_table, read_clean, write_clean
from shoplens.sources.raw import read_raw
from shoplens.sources.upsert import upsert
from shoplens.streaming.loader import batch_progress, ingest
from shoplens.registry import OC_SQL, ORACLE, QUERIES, clean_fact, clean_fact_uncached, register, with_oc
from shoplens.schema import CLEAN_COLUMNS, FEATURE_COLUMNS, RAW_FILES, TARGET_COLUMN
from shoplens.sources.testdata import raw_from_testdata

# A fixed dashboard filter set used by the *_filtered queries.
FILTERS = dict(start_date="1996-01-01", end_date="1997-12-31", state="NATION_7",
               min_revenue=100000.0)
FILTER_SQL = ("WHERE CAST(order_date AS DATE) >= DATE '1996-01-01' "
              "AND CAST(order_date AS DATE) <= DATE '1997-12-31' "
              "AND customer_state = 'NATION_7' AND CAST(payment_value AS DOUBLE) >= 100000.0")
CATEGORY_FILTER = dict(category="standard", max_revenue=300000.0)
CATEGORY_FILTER_SQL = ("WHERE product_category_name = 'standard' "
                       "AND CAST(payment_value AS DOUBLE) <= 300000.0")


def oc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_fact(spark, sf_dir)


# ---- clean layer ----------------------------------------------------------------

@register("orders_clean", with_oc(f"SELECT {', '.join(CLEAN_COLUMNS)} FROM oc"))
def q_orders_clean(spark, sf_dir):
    """J1..J6, A1, A2, P1..P7 end to end (built in-plan, not from the stored copy)."""
    return clean_fact_uncached(spark, sf_dir)


@register("payments_per_order", """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS payment_value
FROM lineitem GROUP BY l_orderkey""")
def q_payments_per_order(spark, sf_dir):
    pay = C.payments_per_order(raw_from_testdata(spark, sf_dir)["payments"])
    return pay.select("order_id", F.col("payment_value").cast("double").alias("payment_value"))


@register("reviews_per_order", """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
       ROUND_EVEN(AVG(CAST(1 + l_linenumber % 5 AS DOUBLE)), 0) AS review_score
FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey""")
def q_reviews_per_order(spark, sf_dir):
    return C.reviews_per_order(raw_from_testdata(spark, sf_dir)["reviews"])


# ---- SQL marts -------------------------------------------------------------------

@register("metrics", with_oc("""
SELECT CAST(COUNT(*) AS BIGINT) AS total_orders,
       CAST(COALESCE(SUM(payment_value), 0) AS DOUBLE) AS total_revenue FROM oc"""))
def q_metrics(spark, sf_dir):
    return M.metrics(oc(spark, sf_dir))


@register("metrics_filtered", with_oc(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total_orders,
       CAST(COALESCE(SUM(payment_value), 0) AS DOUBLE) AS total_revenue FROM oc {FILTER_SQL}"""))
def q_metrics_filtered(spark, sf_dir):
    return M.metrics(oc(spark, sf_dir), **FILTERS)


@register("daily_revenue", with_oc("""
SELECT CAST(order_date AS DATE) AS date,
       CAST(COALESCE(SUM(payment_value), 0) AS DOUBLE) AS total_revenue
FROM oc GROUP BY CAST(order_date AS DATE) ORDER BY date"""))
def q_daily_revenue(spark, sf_dir):
    return M.daily_revenue(oc(spark, sf_dir))


@register("daily_revenue_filtered", with_oc(f"""
SELECT CAST(order_date AS DATE) AS date,
       CAST(COALESCE(SUM(payment_value), 0) AS DOUBLE) AS total_revenue
FROM oc {CATEGORY_FILTER_SQL} GROUP BY CAST(order_date AS DATE) ORDER BY date"""))
def q_daily_revenue_filtered(spark, sf_dir):
    return M.daily_revenue(oc(spark, sf_dir), **CATEGORY_FILTER)


@register("daily_orders", with_oc("""
SELECT CAST(order_date AS DATE) AS date, CAST(COUNT(*) AS BIGINT) AS order_count
FROM oc GROUP BY CAST(order_date AS DATE) ORDER BY date"""))
def q_daily_orders(spark, sf_dir):
    return M.daily_orders(oc(spark, sf_dir))


@register("data_growth", with_oc("""
SELECT date, CAST(SUM(daily_count) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  AS BIGINT) AS cumulative_orders
FROM dc ORDER BY date""", """
dc AS (SELECT CAST(order_date AS DATE) AS date, COUNT(*) AS daily_count FROM oc GROUP BY 1)"""))
def q_data_growth(spark, sf_dir):
    return M.data_growth(oc(spark, sf_dir))


@register("category_analysis", with_oc("""
SELECT product_category_name AS category, CAST(COALESCE(SUM(payment_value), 0) AS DOUBLE) AS revenue
FROM oc GROUP BY product_category_name ORDER BY revenue DESC, category"""))
def q_category_analysis(spark, sf_dir):
    return M.category_analysis(oc(spark, sf_dir))


@register("category_analysis_filtered", with_oc(f"""
SELECT product_category_name AS category, CAST(COALESCE(SUM(payment_value), 0) AS DOUBLE) AS revenue
FROM oc {FILTER_SQL} GROUP BY product_category_name ORDER BY revenue DESC, category"""))
def q_category_analysis_filtered(spark, sf_dir):
    return M.category_analysis(oc(spark, sf_dir), **FILTERS)


@register("geo_analysis", with_oc("""
SELECT customer_state AS state, CAST(COALESCE(SUM(payment_value), 0) AS DOUBLE) AS revenue
FROM oc GROUP BY customer_state ORDER BY revenue DESC, state"""))
def q_geo_analysis(spark, sf_dir):
    return M.geo_analysis(oc(spark, sf_dir))


@register("weekday_analysis", with_oc("""
SELECT CAST(dayofweek(order_date) AS INTEGER) AS day,
       COALESCE(CAST(SUM(payment_value) AS DOUBLE) / COUNT(payment_value), 0.0) AS avg_revenue
FROM oc GROUP BY 1 ORDER BY day"""))
def q_weekday_analysis(spark, sf_dir):
    return M.weekday_analysis(oc(spark, sf_dir))


# quartiles by rank: the value at (n - 1) * q, between two ranks in proportion
SEGMENTS_SQL = """
spend AS (SELECT CAST(COALESCE(SUM(payment_value), 0) AS DOUBLE) AS x FROM oc {where} GROUP BY customer_id),
place AS (SELECT x, ROW_NUMBER() OVER (ORDER BY x) - 1 AS r, 0.25 * (COUNT(*) OVER () - 1) AS q1,
                 0.75 * (COUNT(*) OVER () - 1) AS q3 FROM spend),
quart AS (SELECT MAX(x) FILTER (r = FLOOR(q1)) + (MAX(q1) - FLOOR(MAX(q1)))
                   * (MAX(x) FILTER (r = CEIL(q1)) - MAX(x) FILTER (r = FLOOR(q1))) AS low,
                 MAX(x) FILTER (r = FLOOR(q3)) + (MAX(q3) - FLOOR(MAX(q3)))
                   * (MAX(x) FILTER (r = CEIL(q3)) - MAX(x) FILTER (r = FLOOR(q3))) AS high FROM place),
sized AS (SELECT COUNT(*) FILTER (x > high) AS n0, COUNT(*) FILTER (x < low) AS n2, COUNT(*) AS n FROM spend, quart)"""
SEGMENTS_BODY = """
SELECT * FROM (
SELECT 'High' AS segment, CAST(0 AS INTEGER) AS segment_order, CAST(n0 AS BIGINT) AS count FROM sized
UNION ALL SELECT 'Medium', 1, n - n0 - n2 FROM sized
UNION ALL SELECT 'Low', 2, n2 FROM sized) ORDER BY segment_order"""


@register("customer_segments", with_oc(SEGMENTS_BODY, SEGMENTS_SQL.format(where="")))
def q_customer_segments(spark, sf_dir):
    return M.customer_segments(oc(spark, sf_dir))


@register("customer_segments_filtered", with_oc(SEGMENTS_BODY, SEGMENTS_SQL.format(where=FILTER_SQL)))
def q_customer_segments_filtered(spark, sf_dir):
    return M.customer_segments(oc(spark, sf_dir), **FILTERS)


@register("filter_summary", with_oc("""
SELECT COALESCE(strftime(MIN(order_date), '%Y-%m-%d'), '') AS min_date,
       COALESCE(strftime(MAX(order_date), '%Y-%m-%d'), '') AS max_date,
       CAST(COALESCE(MIN(payment_value), 0) AS DOUBLE) AS min_revenue,
       CAST(COALESCE(MAX(payment_value), 0) AS DOUBLE) AS max_revenue FROM oc"""))
def q_filter_summary(spark, sf_dir):
    return M.filter_summary(oc(spark, sf_dir))


@register("filter_categories", with_oc(
    "SELECT DISTINCT product_category_name FROM oc ORDER BY product_category_name"))
def q_filter_categories(spark, sf_dir):
    return M.distinct_values(oc(spark, sf_dir), "product_category_name")


@register("filter_states", with_oc("SELECT DISTINCT customer_state FROM oc ORDER BY customer_state"))
def q_filter_states(spark, sf_dir):
    return M.distinct_values(oc(spark, sf_dir), "customer_state")


# ---- signals and rules --------------------------------------------------------------

DAILY_CTE = """
dr AS (SELECT CAST(order_date AS DATE) AS date, COALESCE(SUM(payment_value), 0) AS revenue
       FROM oc {where} GROUP BY 1)"""
TREND_CTE = DAILY_CTE + """,
rk AS (SELECT date, revenue, ROW_NUMBER() OVER (ORDER BY date DESC) AS recency_rank FROM dr),
trend AS (SELECT
    COALESCE(CAST(SUM(CASE WHEN recency_rank BETWEEN 1 AND 7 THEN revenue END) AS DOUBLE)
             / COUNT(CASE WHEN recency_rank BETWEEN 1 AND 7 THEN revenue END), 0.0) AS last_7_avg,
    COALESCE(CAST(SUM(CASE WHEN recency_rank BETWEEN 8 AND 14 THEN revenue END) AS DOUBLE)
             / COUNT(CASE WHEN recency_rank BETWEEN 8 AND 14 THEN revenue END), 0.0) AS previous_7_avg
  FROM rk)"""
WEEK_CTE = """
week AS (SELECT
    COALESCE(CAST(SUM(CASE WHEN dayofweek(order_date) IN (0, 6) THEN payment_value END) AS DOUBLE)
             / COUNT(CASE WHEN dayofweek(order_date) IN (0, 6) THEN payment_value END), 0.0) AS weekend_avg,
    COALESCE(CAST(SUM(CASE WHEN dayofweek(order_date) BETWEEN 1 AND 5 THEN payment_value END) AS DOUBLE)
             / COUNT(CASE WHEN dayofweek(order_date) BETWEEN 1 AND 5 THEN payment_value END), 0.0) AS weekday_avg
  FROM oc {where})"""
TOP_CTE = """
ranked_cat AS (SELECT product_category_name, SUM(payment_value) AS rev, SUM(SUM(payment_value)) OVER () AS every,
                      ROW_NUMBER() OVER (ORDER BY SUM(payment_value) DESC NULLS LAST, product_category_name) AS place
               FROM oc {where} GROUP BY product_category_name),
topc AS (SELECT product_category_name, COALESCE(CAST(rev AS DOUBLE), 0) AS revenue,
                COALESCE(CAST(every AS DOUBLE), 0) AS total_revenue,
                COALESCE(CAST(rev AS DOUBLE) / NULLIF(CAST(every AS DOUBLE), 0), 0.0) AS revenue_share
         FROM ranked_cat WHERE place = 1)"""
ANOM_CTE = DAILY_CTE.replace("dr AS", "da AS") + """,
sc AS (SELECT CAST(SUM(revenue) AS DOUBLE) / COUNT(*) AS mean_revenue, STDDEV_POP(CAST(revenue AS DOUBLE)) AS std_revenue FROM da),
z AS (SELECT date, revenue, mean_revenue, std_revenue,
             CASE WHEN std_revenue = 0 THEN 0.0
                  ELSE (CAST(revenue AS DOUBLE) - mean_revenue) / std_revenue END AS z_score
      FROM da CROSS JOIN sc),
anom AS (SELECT CAST(COUNT(CASE WHEN ABS(z_score) > 2.5 THEN 1 END) AS BIGINT) AS anomaly_count FROM z)"""
CTX_CTE = ",\n".join(x.strip() for x in (TREND_CTE, WEEK_CTE, TOP_CTE, ANOM_CTE)) + """,
ctx AS (SELECT last_7_avg, previous_7_avg, weekend_avg, weekday_avg,
               COALESCE((SELECT MAX(product_category_name) FROM topc), 'Unknown') AS top_category,
               COALESCE((SELECT MAX(revenue_share) FROM topc), 0.0) AS top_category_share,
               anomaly_count
        FROM trend CROSS JOIN week CROSS JOIN anom)"""
INSIGHT_CTE = CTX_CTE + """,
ins_slots AS (
  SELECT 1 AS slot, CASE WHEN last_7_avg > previous_7_avg AND previous_7_avg > 0 THEN 'Revenue is trending upward 📈'
                         WHEN previous_7_avg > last_7_avg AND last_7_avg > 0 THEN 'Revenue is trending downward ⚠️'
                         ELSE 'Revenue is broadly stable' END AS insight FROM ctx
  UNION ALL
  SELECT 2, CASE WHEN weekend_avg > weekday_avg AND weekday_avg > 0 THEN 'Weekend sales are higher than weekday sales'
                 WHEN weekday_avg > weekend_avg AND weekend_avg > 0 THEN 'Weekday sales outperform weekends' END FROM ctx
  UNION ALL
  SELECT 3, CASE WHEN top_category_share >= 0.25 THEN top_category || ' contributes the largest revenue share'
                 WHEN top_category <> 'Unknown' THEN top_category || ' is the top revenue category' END FROM ctx
  UNION ALL
  SELECT 4, CASE WHEN anomaly_count > 0 THEN CAST(anomaly_count AS VARCHAR) || ' revenue anomalies need review ⚠️' END
  FROM ctx),
ins AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY slot) - 1 AS INTEGER) AS position, insight
        FROM ins_slots WHERE insight IS NOT NULL)"""
RECO_CTE = INSIGHT_CTE + """,
txt AS (SELECT LOWER(STRING_AGG(insight, ' ' ORDER BY position)) AS t FROM ins),
reco_slots AS (
  SELECT 1 AS slot, CASE WHEN contains(t, 'weekend sales are higher') THEN 'Focus promotions and ad spend on weekends'
                         WHEN contains(t, 'weekday sales outperform')
                              THEN 'Prioritize weekday campaigns and operational coverage' END AS recommendation FROM txt
  UNION ALL
  SELECT 2, CASE WHEN contains(t, 'top revenue category') OR contains(t, 'largest revenue share')
                 THEN 'Expand inventory and merchandising around top-performing categories' END FROM txt
  UNION ALL
  SELECT 3, CASE WHEN contains(t, 'anomalies need review')
                 THEN 'Investigate revenue anomalies before scaling campaigns' END FROM txt
  UNION ALL
  SELECT 4, CASE WHEN contains(t, 'trending downward')
                      THEN 'Review recent pricing, stock availability, and campaign performance'
                 WHEN contains(t, 'trending upward')
                      THEN 'Protect current growth by monitoring fulfillment capacity and stock levels' END FROM txt),
reco AS (SELECT slot, recommendation FROM reco_slots WHERE recommendation IS NOT NULL
         UNION ALL
         SELECT 5, 'Continue monitoring revenue, category mix, and anomaly signals'
         WHERE NOT EXISTS (SELECT 1 FROM reco_slots WHERE recommendation IS NOT NULL))"""


def _ctes(template: str, where: str = "") -> str:
    return template.replace("{where}", where)


@register("trend_signal", with_oc("SELECT * FROM trend", _ctes(TREND_CTE)))
def q_trend_signal(spark, sf_dir):
    return G.trend_signal(oc(spark, sf_dir))


@register("weekpart_signal", with_oc("SELECT * FROM week", _ctes(WEEK_CTE)))
def q_weekpart_signal(spark, sf_dir):
    return G.weekpart_signal(oc(spark, sf_dir))


@register("top_category", with_oc("SELECT * FROM topc", _ctes(TOP_CTE)))
def q_top_category(spark, sf_dir):
    return G.top_category(oc(spark, sf_dir))


@register("anomaly_count", with_oc("SELECT * FROM anom", _ctes(ANOM_CTE)))
def q_anomaly_count(spark, sf_dir):
    return G.anomaly_count(oc(spark, sf_dir))


@register("signal_context", with_oc("SELECT * FROM ctx", _ctes(CTX_CTE)))
def q_signal_context(spark, sf_dir):
    return G.signal_context(oc(spark, sf_dir))


@register("signal_context_filtered", with_oc("SELECT * FROM ctx", _ctes(CTX_CTE, FILTER_SQL)))
def q_signal_context_filtered(spark, sf_dir):
    return G.signal_context(oc(spark, sf_dir), **FILTERS)


@register("insights", with_oc("SELECT position, insight FROM ins", _ctes(INSIGHT_CTE)))
def q_insights(spark, sf_dir):
    return R.insights(G.signal_context(oc(spark, sf_dir)))


@register("insights_filtered", with_oc("SELECT position, insight FROM ins", _ctes(INSIGHT_CTE, CATEGORY_FILTER_SQL)))
def q_insights_filtered(spark, sf_dir):
    return R.insights(G.signal_context(oc(spark, sf_dir), **CATEGORY_FILTER))


@register("recommendations", with_oc("""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY slot) - 1 AS INTEGER) AS position, recommendation FROM reco""",
                                     _ctes(RECO_CTE)))
def q_recommendations(spark, sf_dir):
    return R.recommendations(G.signal_context(oc(spark, sf_dir)))


# ---- customer analytics ------------------------------------------------------------------

def orders7(spark, sf_dir):
    """P9 over the clean fact (seven columns)."""
    return C.prepare_orders(clean_fact(spark, sf_dir))


ORDERS_CTE = """
o AS (SELECT order_id, customer_id, order_date, payment_value, product_category_name, customer_state,
             CAST(review_score AS DOUBLE) AS review_score
      FROM oc WHERE order_date IS NOT NULL AND customer_id <> 'Unknown')"""
COHORT_CTE = ORDERS_CTE + """,
cm AS (SELECT DISTINCT customer_id, CAST(date_trunc('month', order_date) AS DATE) AS order_month FROM o),
fp AS (SELECT customer_id, MIN(order_month) AS cohort_month FROM cm GROUP BY customer_id),
act AS (SELECT fp.cohort_month,
               (year(cm.order_month) - year(fp.cohort_month)) * 12
                 + (month(cm.order_month) - month(fp.cohort_month)) AS period_number,
               COUNT(*) AS active_customers
        FROM cm JOIN fp ON cm.customer_id = fp.customer_id GROUP BY 1, 2),
sz AS (SELECT cohort_month, COUNT(*) AS cohort_size FROM fp GROUP BY 1),
r AS (SELECT act.cohort_month, act.period_number,
             CAST(active_customers AS DOUBLE) / cohort_size * 100.0 AS retention_pct
      FROM act JOIN sz ON act.cohort_month = sz.cohort_month),
grid AS (SELECT cohort_month, UNNEST(generate_series(0, (SELECT MAX(period_number) FROM r))) AS period_number
         FROM (SELECT DISTINCT cohort_month FROM r)),
long AS (SELECT strftime(grid.cohort_month, '%Y-%m') AS cohort_month,
                CAST(grid.period_number AS INTEGER) AS period_number,
                CASE WHEN grid.period_number = 0 THEN 100.0
                     ELSE ROUND_EVEN(COALESCE(r.retention_pct, 0.0), 2) END AS retention_pct
         FROM grid LEFT JOIN r ON grid.cohort_month = r.cohort_month AND grid.period_number = r.period_number)"""


@register("cohort_retention_long", with_oc("SELECT * FROM long ORDER BY cohort_month, period_number",
                                           COHORT_CTE))
def q_cohort_retention_long(spark, sf_dir):
    return A.cohort_retention_long(orders7(spark, sf_dir))


@register("cohort_retention", with_oc("""
SELECT cohort_month, LIST(retention_pct ORDER BY period_number) AS retention
FROM long GROUP BY cohort_month ORDER BY cohort_month""", COHORT_CTE))
def q_cohort_retention(spark, sf_dir):
    return A.cohort_retention(orders7(spark, sf_dir))


@register("revenue_decomposition", with_oc("""
SELECT CASE WHEN n0c = 0 OR n1c = 0 OR r0 = 0 THEN 0.0 ELSE ROUND_EVEN((r1 - r0) / r0 * 100.0, 2) END
         AS total_change_pct,
       CASE WHEN n0c = 0 OR n1c = 0 OR r0 = 0 THEN 0.0 ELSE ROUND_EVEN((n1 - n0) * (r0 / n0) / r0 * 100.0, 2) END
         AS order_contribution_pct,
       CASE WHEN n0c = 0 OR n1c = 0 OR r0 = 0 THEN 0.0
            ELSE ROUND_EVEN(n1 * (r1 / n1 - r0 / n0) / r0 * 100.0, 2) END AS aov_contribution_pct,
       r0 AS previous_revenue, r1 AS current_revenue,
       CAST(n0c AS BIGINT) AS previous_orders, CAST(n1c AS BIGINT) AS current_orders
FROM (SELECT *, CAST(GREATEST(n0c, 1) AS DOUBLE) AS n0, CAST(GREATEST(n1c, 1) AS DOUBLE) AS n1 FROM tot)""",
                                           ORDERS_CTE + """,
b AS (SELECT MIN(order_date) AS s, MAX(order_date) AS e FROM o),
t AS (SELECT o.*, 2 * date_diff('microsecond', b.s, o.order_date) <= date_diff('microsecond', b.s, b.e) AS prev
      FROM o CROSS JOIN b),
po AS (SELECT order_id, MAX(CAST(prev AS INTEGER)) AS has_prev, MAX(CAST(NOT prev AS INTEGER)) AS has_cur,
              SUM(CASE WHEN prev THEN payment_value END) AS rev_prev,
              SUM(CASE WHEN NOT prev THEN payment_value END) AS rev_cur
       FROM t GROUP BY order_id),
tot AS (SELECT COALESCE(SUM(has_prev), 0) AS n0c, COALESCE(SUM(has_cur), 0) AS n1c,
               CAST(COALESCE(SUM(rev_prev), 0) AS DOUBLE) AS r0, CAST(COALESCE(SUM(rev_cur), 0) AS DOUBLE) AS r1
        FROM po)"""))
def q_revenue_decomposition(spark, sf_dir):
    return A.revenue_decomposition(orders7(spark, sf_dir))


CHURN_CTE = ORDERS_CTE + """,
ad AS (SELECT MAX(order_date) AS analysis_date FROM o),
t AS (SELECT o.*, ad.analysis_date, o.order_date > ad.analysis_date - INTERVAL 30 DAY AS cur,
             o.order_date > ad.analysis_date - INTERVAL 60 DAY
               AND o.order_date <= ad.analysis_date - INTERVAL 30 DAY AS prev
      FROM o CROSS JOIN ad),
po AS (SELECT customer_id, order_id, MAX(order_date) AS last_date, MAX(analysis_date) AS analysis_date,
              SUM(payment_value) AS spend, MAX(CAST(cur AS INTEGER)) AS in_cur, MAX(CAST(prev AS INTEGER)) AS in_prev,
              SUM(CASE WHEN cur THEN payment_value END) AS spend_cur,
              SUM(CASE WHEN prev THEN payment_value END) AS spend_prev
       FROM t GROUP BY customer_id, order_id),
cu AS (SELECT customer_id, MAX(last_date) AS last_order_date, MAX(analysis_date) AS analysis_date,
              SUM(spend) AS total_spent, COUNT(*) AS total_orders, SUM(in_cur) AS current_orders,
              SUM(in_prev) AS previous_orders, COALESCE(SUM(spend_cur), 0) AS current_spend,
              COALESCE(SUM(spend_prev), 0) AS previous_spend
       FROM po GROUP BY customer_id),
cc AS (SELECT customer_id, last_order_date,
              CAST(date_diff('microsecond', last_order_date, analysis_date) // 86400000000 AS BIGINT)
                AS days_since_last_purchase,
              CAST(total_spent AS DOUBLE) AS total_spent, CAST(total_orders AS BIGINT) AS total_orders,
              CAST(current_orders AS BIGINT) AS current_orders, CAST(previous_orders AS BIGINT) AS previous_orders,
              CAST(current_spend AS DOUBLE) AS current_spend, CAST(previous_spend AS DOUBLE) AS previous_spend,
              CASE WHEN total_orders > 0 THEN CAST(total_spent AS DOUBLE) / total_orders ELSE 0.0 END
                AS avg_order_value
       FROM cu),
churn AS (SELECT *, days_since_last_purchase > 30
                    AND (current_orders < previous_orders OR current_spend < previous_spend) AS is_high_risk,
                 GREATEST(previous_spend, avg_order_value) AS potential_loss
          FROM cc)"""


@register("churn_customers", with_oc("SELECT * FROM churn", CHURN_CTE))
def q_churn_customers(spark, sf_dir):
    return A.churn_customers(orders7(spark, sf_dir))


@register("churn_risk", with_oc("""
SELECT CAST(COUNT(*) AS BIGINT) AS high_risk_customers,
       ROUND_EVEN(COALESCE(SUM(potential_loss), 0.0), 2) AS potential_revenue_loss
FROM churn WHERE is_high_risk""", CHURN_CTE))
def q_churn_risk(spark, sf_dir):
    return A.churn_risk(orders7(spark, sf_dir))


LTV_CTE = ORDERS_CTE + """,
po AS (SELECT customer_id, order_id, SUM(payment_value) AS spend, MIN(order_date) AS first_date,
              MAX(order_date) AS last_date FROM o GROUP BY customer_id, order_id),
cu AS (SELECT customer_id, CAST(SUM(spend) AS DOUBLE) AS total_spent, CAST(COUNT(*) AS BIGINT) AS total_orders,
              MIN(first_date) AS first_order_date, MAX(last_date) AS last_order_date FROM po GROUP BY customer_id),
cv AS (SELECT *, CAST(GREATEST(date_diff('microsecond', first_order_date, last_order_date) // 86400000000, 1)
                      AS BIGINT) AS active_days FROM cu),
lv AS (SELECT *, CASE WHEN total_orders > 0 THEN total_spent / total_orders ELSE 0.0 END AS avg_order_value,
              CASE WHEN active_days > 0 THEN total_orders / active_days ELSE 0.0 END AS purchase_frequency
       FROM cv)"""


@register("customer_ltv", with_oc("""
SELECT customer_id, ROUND_EVEN(avg_order_value * purchase_frequency * active_days, 2) AS ltv,
       total_spent, total_orders, active_days, avg_order_value, purchase_frequency
FROM lv ORDER BY avg_order_value * purchase_frequency * active_days DESC, customer_id LIMIT 10""", LTV_CTE))
def q_customer_ltv(spark, sf_dir):
    return A.customer_ltv(orders7(spark, sf_dir), 10)


def root_cause_sql(dim: str, prefix: str) -> str:
    return f"""
{prefix}_d AS (SELECT CAST(order_date AS DATE) AS order_day, {dim} AS label, SUM(payment_value) AS rev
               FROM o GROUP BY 1, 2),
{prefix}_t AS (SELECT label, SUM(rev) AS s, COUNT(*) AS n FROM {prefix}_d GROUP BY label),
{prefix}_top AS (SELECT * FROM (SELECT {prefix}_d.*, ROW_NUMBER() OVER (PARTITION BY order_day
                                                     ORDER BY rev DESC, label) AS rn
                               FROM {prefix}_d WHERE order_day IN (SELECT order_day FROM days)) WHERE rn = 1),
{prefix}_res AS (SELECT x.order_day, x.label AS top_{prefix},
   ROUND_EVEN(CASE WHEN base IS NULL THEN NULL
                   WHEN base <= 0 THEN CASE WHEN CAST(rev AS DOUBLE) <= 0 THEN 0.0 ELSE 100.0 END
                   ELSE (CAST(rev AS DOUBLE) - base) / base * 100.0 END, 2) AS {prefix}_increase_pct
   FROM (SELECT t.order_day, t.label, t.rev,
                CASE WHEN tt.n > 1 THEN CAST(tt.s - t.rev AS DOUBLE) / (tt.n - 1) END AS base
         FROM {prefix}_top t JOIN {prefix}_t tt ON t.label = tt.label) x)"""


ROOT_CAUSE_CTE = ORDERS_CTE + """,
da AS (SELECT CAST(order_date AS DATE) AS order_day, SUM(payment_value) AS revenue FROM o GROUP BY 1),
sc AS (SELECT CAST(SUM(revenue) AS DOUBLE) / COUNT(*) AS mean_revenue, STDDEV_POP(CAST(revenue AS DOUBLE)) AS std_revenue FROM da),
z AS (SELECT order_day, CASE WHEN std_revenue = 0 THEN 0.0
                             ELSE (CAST(revenue AS DOUBLE) - mean_revenue) / std_revenue END AS z_score
      FROM da CROSS JOIN sc),
days AS (SELECT order_day FROM z WHERE ABS(z_score) > 2.5 AND (SELECT COUNT(*) FROM da) > 1),""" + \
    root_cause_sql("product_category_name", "category") + "," + root_cause_sql("customer_state", "state")


@register("anomaly_root_cause", with_oc("""
SELECT c.order_day AS date, top_category, category_increase_pct, top_state, state_increase_pct
FROM category_res c JOIN state_res s ON c.order_day = s.order_day ORDER BY date""", ROOT_CAUSE_CTE))
def q_anomaly_root_cause(spark, sf_dir):
    return A.anomaly_root_cause(orders7(spark, sf_dir))


# ---- time series ------------------------------------------------------------------------

SERIES_CTE = """
obs AS (SELECT CAST(order_date AS DATE) AS date, CAST(COALESCE(SUM(payment_value), 0) AS DOUBLE) AS daily_revenue
        FROM oc WHERE order_date IS NOT NULL GROUP BY 1),
cal AS (SELECT CAST(UNNEST(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date FROM obs),
gj AS (SELECT cal.date, obs.daily_revenue FROM cal LEFT JOIN obs ON cal.date = obs.date),
nb AS (SELECT date, daily_revenue,
         LAST_VALUE(daily_revenue IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y0,
         LAST_VALUE(CASE WHEN daily_revenue IS NOT NULL THEN date END IGNORE NULLS)
           OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x0,
         FIRST_VALUE(daily_revenue IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y1,
         FIRST_VALUE(CASE WHEN daily_revenue IS NOT NULL THEN date END IGNORE NULLS)
           OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1
       FROM gj),
series AS (SELECT date,
             CASE WHEN daily_revenue IS NOT NULL THEN daily_revenue
                  WHEN y0 IS NOT NULL AND y1 IS NOT NULL
                    THEN y0 + (y1 - y0) / date_diff('day', x0, x1) * date_diff('day', x0, date)
                  ELSE COALESCE(y0, y1, 0.0) END AS daily_revenue
           FROM nb)"""

def _win(frame: str = "", part: str = "") -> str:
    by = f"PARTITION BY {part} " if part else ""
    return f"OVER ({by}ORDER BY date" + ((" ROWS BETWEEN " + frame) if frame else "") + ")"


def _sql_lag(k: int, part: str = "") -> str:
    return f"LAG(daily_revenue, {k}) {_win(part=part)}"


def _sql_cnt(n: int, part: str = "") -> str:
    return "(" + " + ".join(f"CASE WHEN {_sql_lag(k, part)} IS NOT NULL THEN 1 ELSE 0 END"
                            for k in range(1, n + 1)) + ")"


def _sql_sum(terms: list[str]) -> str:
    return "(" + " + ".join(f"COALESCE({t}, 0.0)" for t in terms) + ")"


def _sql_mean(n: int, part: str = "") -> str:
    lags = [_sql_lag(k, part) for k in range(1, n + 1)]
    return f"CASE WHEN {_sql_cnt(n, part)} > 0 THEN {_sql_sum(lags)} / {_sql_cnt(n, part)} END"


def _sql_std(n: int, part: str = "") -> str:
    mean = f"({_sql_sum([_sql_lag(k, part) for k in range(1, n + 1)])} / {_sql_cnt(n, part)})"
    sq = [f"CASE WHEN {_sql_lag(k, part)} IS NOT NULL THEN ({_sql_lag(k, part)} - {mean}) * "
          f"({_sql_lag(k, part)} - {mean}) END" for k in range(1, n + 1)]
    return f"CASE WHEN {_sql_cnt(n, part)} >= 2 THEN SQRT({_sql_sum(sq)} / {_sql_cnt(n, part)}) ELSE 0.0 END"


def features_cte(source: str, part: str = "", prefix: str = "") -> str:
    """``<prefix>rawf`` / ``<prefix>features`` CTEs over a (key?, date, daily_revenue) series."""
    key = f"{part}, " if part else ""
    w = lambda frame="": _win(frame, part)
    lag = lambda k: _sql_lag(k, part)
    return f"""
{prefix}rawf AS (SELECT {key}date, daily_revenue,
   CAST(isodow(date) - 1 AS DOUBLE) AS day_of_week, CAST(dayofmonth(date) AS DOUBLE) AS day_of_month,
   CAST(month(date) AS DOUBLE) AS month, CAST(quarter(date) AS DOUBLE) AS quarter,
   CASE WHEN isodow(date) - 1 IN (5, 6) THEN 1.0 ELSE 0.0 END AS is_weekend,
   {lag(1)} AS lag_1, {lag(2)} AS lag_2, {lag(3)} AS lag_3, {lag(7)} AS lag_7,
   {_sql_mean(3, part)} AS rolling_mean_3, {_sql_mean(7, part)} AS rolling_mean_7,
   {_sql_mean(14, part)} AS rolling_mean_14, {_sql_std(7, part)} AS rolling_std_7,
   {lag(1)} - {lag(2)} AS revenue_change_1
 FROM {source}),
{prefix}features AS (SELECT {key}date, daily_revenue, """ + ",\n ".join(
        f"CAST(COALESCE({c}, LAST_VALUE({c} IGNORE NULLS) {w('UNBOUNDED PRECEDING AND CURRENT ROW')}, "
        f"FIRST_VALUE({c} IGNORE NULLS) {w('CURRENT ROW AND UNBOUNDED FOLLOWING')}, 0.0) AS DOUBLE) AS {c}"
        for c in FEATURE_COLUMNS) + f" FROM {prefix}rawf)"


FEATURES_CTE = SERIES_CTE + "," + features_cte("series")


@register("daily_series", with_oc("SELECT date, daily_revenue FROM series ORDER BY date", SERIES_CTE))
def q_daily_series(spark, sf_dir):
    return TS.daily_series(oc(spark, sf_dir))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round DOUBLE columns half-even: window sums in two engines differ in the last ulp."""
    return df.select(*[F.bround(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("time_features", with_oc(f"SELECT date, daily_revenue, {', '.join(FEATURE_COLUMNS)} "
                                   "FROM features ORDER BY date", FEATURES_CTE))
def q_time_features(spark, sf_dir):
    return TS.feature_frame(oc(spark, sf_dir))


NEXT_DAY_CTE = SERIES_CTE + """,
rk AS (SELECT date, daily_revenue, ROW_NUMBER() OVER (ORDER BY date DESC) AS rn FROM series),
ag AS (SELECT MAX(date) AS last_date, COUNT(*) AS n,
              MAX(CASE WHEN rn = 1 THEN daily_revenue END) AS v1, MAX(CASE WHEN rn = 2 THEN daily_revenue END) AS v2,
              MAX(CASE WHEN rn = 3 THEN daily_revenue END) AS v3, MAX(CASE WHEN rn = 7 THEN daily_revenue END) AS v7,
              ARG_MIN(daily_revenue, date) AS first_v,
              AVG(CASE WHEN rn <= 3 THEN daily_revenue END) AS m3, AVG(CASE WHEN rn <= 7 THEN daily_revenue END) AS m7,
              AVG(CASE WHEN rn <= 14 THEN daily_revenue END) AS m14,
              STDDEV_POP(CASE WHEN rn <= 7 THEN daily_revenue END) AS s7,
              COUNT(CASE WHEN rn <= 7 THEN daily_revenue END) AS c7
       FROM rk),
nd AS (SELECT CAST(last_date + INTERVAL 1 DAY AS DATE) AS date, * FROM ag)"""


@register("next_day_features", with_oc("""
SELECT date, CAST(isodow(date) - 1 AS DOUBLE) AS day_of_week, CAST(dayofmonth(date) AS DOUBLE) AS day_of_month,
       CAST(month(date) AS DOUBLE) AS month, CAST(quarter(date) AS DOUBLE) AS quarter,
       CAST(CASE WHEN isodow(date) - 1 IN (5, 6) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS is_weekend,
       v1 AS lag_1, CASE WHEN n >= 2 THEN v2 ELSE v1 END AS lag_2, CASE WHEN n >= 3 THEN v3 ELSE v1 END AS lag_3,
       CASE WHEN n >= 7 THEN v7 ELSE first_v END AS lag_7,
       m3 AS rolling_mean_3, m7 AS rolling_mean_7, m14 AS rolling_mean_14,
       CASE WHEN c7 >= 2 THEN s7 ELSE 0.0 END AS rolling_std_7,
       CASE WHEN n >= 2 THEN v1 - v2 ELSE 0.0 END AS revenue_change_1
FROM nd""", NEXT_DAY_CTE))
def q_next_day_features(spark, sf_dir):
    return TS.next_day_features(TS.daily_series(oc(spark, sf_dir)))


@register("training_split", with_oc("""
SELECT date, daily_revenue, position,
       CASE WHEN n < 5 OR position <= LEAST(GREATEST(FLOOR(n * 0.8), 1), n - 1) THEN 'train' ELSE 'test' END AS split
FROM (SELECT date, daily_revenue, ROW_NUMBER() OVER (ORDER BY date) AS position, COUNT(*) OVER () AS n
      FROM features WHERE daily_revenue IS NOT NULL)""", FEATURES_CTE))
def q_training_split(spark, sf_dir):
    split = TS.time_split(TS.clean_training(TS.feature_frame(oc(spark, sf_dir))))
    return split.select("date", "daily_revenue", "position", "split")


@register("anomalies", with_oc("""
SELECT date, ROUND_EVEN(daily_revenue, 6) AS revenue, ROUND_EVEN((daily_revenue - mu) / sd, 6) AS z_score
FROM series CROSS JOIN (SELECT AVG(daily_revenue) AS mu, STDDEV_POP(daily_revenue) AS sd FROM series)
WHERE sd <> 0 AND ABS((daily_revenue - mu) / sd) > 2.5 ORDER BY date""", SERIES_CTE))
def q_anomalies(spark, sf_dir):
    return round_doubles(TS.detect_anomalies(TS.daily_series(oc(spark, sf_dir))))


STATE_SERIES_CTE = """
sobs AS (SELECT customer_state, CAST(order_date AS DATE) AS date,
                CAST(COALESCE(SUM(payment_value), 0) AS DOUBLE) AS daily_revenue
         FROM oc GROUP BY 1, 2),
scal AS (SELECT customer_state, CAST(UNNEST(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date
         FROM sobs GROUP BY customer_state),
sj AS (SELECT scal.customer_state, scal.date, sobs.daily_revenue FROM scal
       LEFT JOIN sobs ON scal.customer_state = sobs.customer_state AND scal.date = sobs.date),
snb AS (SELECT customer_state, date, daily_revenue,
   LAST_VALUE(daily_revenue IGNORE NULLS) OVER (PARTITION BY customer_state ORDER BY date
     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y0,
   LAST_VALUE(CASE WHEN daily_revenue IS NOT NULL THEN date END IGNORE NULLS) OVER (PARTITION BY customer_state
     ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x0,
   FIRST_VALUE(daily_revenue IGNORE NULLS) OVER (PARTITION BY customer_state ORDER BY date
     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y1,
   FIRST_VALUE(CASE WHEN daily_revenue IS NOT NULL THEN date END IGNORE NULLS) OVER (PARTITION BY customer_state
     ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1
   FROM sj),
sseries AS (SELECT customer_state, date,
   CASE WHEN daily_revenue IS NOT NULL THEN daily_revenue
        WHEN y0 IS NOT NULL AND y1 IS NOT NULL THEN y0 + (y1 - y0) / date_diff('day', x0, x1) * date_diff('day', x0, date)
        ELSE COALESCE(y0, y1, 0.0) END AS daily_revenue FROM snb)"""


@register("state_daily_series", with_oc("SELECT customer_state, date, daily_revenue FROM sseries", STATE_SERIES_CTE))
def q_state_daily_series(spark, sf_dir):
    """F1 with keys: one gap-filled series per customer state (scales out by key)."""
    return TS.daily_series(oc(spark, sf_dir), ["customer_state"])


@register("state_anomalies", with_oc("""
SELECT customer_state, date, ROUND_EVEN(daily_revenue, 6) AS revenue, ROUND_EVEN((daily_revenue - mu) / sd, 6) AS z_score
FROM sseries JOIN (SELECT customer_state AS k, AVG(daily_revenue) AS mu, STDDEV_POP(daily_revenue) AS sd
                   FROM sseries GROUP BY customer_state) st ON sseries.customer_state = st.k
WHERE sd <> 0 AND ABS((daily_revenue - mu) / sd) > 2.5""", STATE_SERIES_CTE))
def q_state_anomalies(spark, sf_dir):
    """F11 with keys: z-score anomalies of every state's own gap-filled series."""
    keys = ["customer_state"]
    return round_doubles(TS.detect_anomalies(TS.daily_series(oc(spark, sf_dir), keys), keys))


@register("state_time_features", with_oc(
    f"SELECT customer_state, date, daily_revenue, {', '.join(FEATURE_COLUMNS)} FROM sfeatures",
    STATE_SERIES_CTE + "," + features_cte("sseries", "customer_state", "s")))
def q_state_time_features(spark, sf_dir):
    """F2 with keys: every state's feature frame, windows partitioned by state."""
    return TS.feature_frame(oc(spark, sf_dir), ["customer_state"])


@register("segment_thresholds_approx", with_oc("""
SELECT UNNEST(['p25', 'p75']) AS threshold, TRUE AS within, customers
FROM (SELECT CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS customers FROM oc)"""))
def q_segment_thresholds_approx(spark, sf_dir):
    """A9 with a sketch: is the rank of each threshold within the stated error of its own?"""
    spend = materialize(M.customer_spend(oc(spark, sf_dir)), "customer_spend")
    th = M.segment_thresholds(spend, approx=True)
    x = F.col("total_spend").cast("double")
    count = lambda cond: F.count(F.when(cond, 1))
    ranks = spend.crossJoin(F.broadcast(th)).agg(  # one row of thresholds
        *(count(x < F.col(p)).alias(f"{p}_under") for p in ("p25", "p75")), *(count(x <= F.col(p)).alias(f"{p}_upto") for p in ("p25", "p75")),
        F.count(F.lit(1)).alias("customers"))
    within = lambda p, q: ((F.col(f"{p}_under") <= (q + M.RANK_ERROR) * F.col("customers"))
                           & (F.col(f"{p}_upto") >= (q - M.RANK_ERROR) * F.col("customers")))
    each = F.array(F.struct(F.lit("p25").alias("threshold"), within("p25", 0.25).alias("within")),
                   F.struct(F.lit("p75").alias("threshold"), within("p75", 0.75).alias("within")))
    return ranks.select(F.explode(each).alias("e"), "customers").select("e.threshold", "e.within", "customers")


# ---- batches, validation, upsert, streaming -----------------------------------------------

BATCH_SIZE = 1000
ROWNUM_SQL = ("ROW_NUMBER() OVER (ORDER BY order_date, order_id, product_id, customer_id)")


@register("row_batches", with_oc(f"""
SELECT order_id, product_id, order_date, CAST(({ROWNUM_SQL} - 1) // {BATCH_SIZE} AS INTEGER) AS batch_id FROM oc"""))
def q_row_batches(spark, sf_dir):
    """S4 over the whole clean fact (distributed numbering)."""
    return B.split_row_batches(oc(spark, sf_dir), BATCH_SIZE).select("order_id", "product_id", "order_date", "batch_id")


@register("daily_batches", with_oc("""
SELECT batch_id, CAST(COUNT(*) AS BIGINT) AS rows, MIN(CAST(order_date AS DATE)) AS day
FROM (SELECT order_date, CAST(DENSE_RANK() OVER (ORDER BY CAST(order_date AS DATE)) - 1 AS INTEGER) AS batch_id FROM oc)
GROUP BY batch_id"""))
def q_daily_batches(spark, sf_dir):
    """S5, summarised per batch."""
    b = B.split_daily_batches(oc(spark, sf_dir))
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                                     F.min(F.to_date("order_date")).alias("day"))


@register("check_clean", with_oc("""
SELECT CAST(COUNT(*) AS BIGINT) AS rows, CAST(COUNT(*) FILTER (WHERE order_id IS NULL) AS BIGINT) AS null_order_ids,
       CAST(COUNT(*) FILTER (WHERE order_date IS NULL) AS BIGINT) AS invalid_dates,
       CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT order_id, product_id, order_date FROM oc)) AS BIGINT)
         AS duplicate_rows,
       COUNT(*) > 0 AND COUNT(*) FILTER (WHERE order_id IS NULL) = 0 AND COUNT(*) FILTER (WHERE order_date IS NULL) = 0
         AND COUNT(*) = (SELECT COUNT(*) FROM (SELECT DISTINCT order_id, product_id, order_date FROM oc)) AS passed
FROM oc"""))
def q_check_clean(spark, sf_dir):
    return V.check_clean(oc(spark, sf_dir))


@register("check_clean_in_flight", ORACLE["check_clean"])
def q_check_clean_in_flight(spark, sf_dir):
    """V1 counted while the table is written."""
    return V.write_checked(oc(spark, sf_dir).select(*CLEAN_COLUMNS), work_dir(spark, "checked"))


@register("check_batches", with_oc(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total_batches, CAST(SUM(rows) AS BIGINT) AS total_rows,
       MIN(batch_id) AS first_id, CAST(MAX(batch_id) - MIN(batch_id) + 1 - COUNT(*) AS BIGINT) AS gaps,
       CAST(COUNT(*) FILTER (WHERE rows = 0) AS BIGINT) AS empty_batches,
       CAST(COUNT(*) FILTER (WHERE batch_id < (SELECT MAX(batch_id) FROM bs) AND rows <> {BATCH_SIZE}) AS BIGINT)
         AS wrong_size,
       CAST(MAX(CASE WHEN batch_id = (SELECT MAX(batch_id) FROM bs) THEN rows END) AS BIGINT) AS last_batch_size,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM oc) AS source_rows,
       CAST(COUNT(*) FILTER (WHERE batch_id IS NULL) AS BIGINT) AS invalid_names,
       MIN(batch_id) = 0 AND MAX(batch_id) + 1 = COUNT(*) AND MAX(rows) <= {BATCH_SIZE} AND MIN(rows) > 0
         AND COUNT(*) FILTER (WHERE rows < {BATCH_SIZE} AND batch_id < (SELECT MAX(batch_id) FROM bs)) = 0
         AND SUM(rows) = (SELECT COUNT(*) FROM oc) AS passed
FROM bs""", f"""
bs AS (SELECT CAST((rn - 1) // {BATCH_SIZE} AS INTEGER) AS batch_id, COUNT(*) AS rows
       FROM (SELECT {ROWNUM_SQL} AS rn FROM oc) GROUP BY 1)"""))
def q_check_batches(spark, sf_dir):
    """V2 over batches written to and read back from storage."""
    fact = oc(spark, sf_dir)
    path = work_dir(spark, "batches")
    B.write_batches(B.split_row_batches(fact, BATCH_SIZE), path, in_order=True)
    return V.check_batches(B.read_batches(spark, path), fact, BATCH_SIZE)


RECUT_SQL = with_oc(f"""
SELECT batch_id, CAST(COUNT(*) AS BIGINT) AS rows, MIN(order_date) AS first_date, MAX(order_date) AS last_date
FROM (SELECT order_date, CAST(({ROWNUM_SQL} - 1) // {BATCH_SIZE} AS INTEGER) AS batch_id FROM oc) GROUP BY batch_id""")


@register("row_batches_recut", RECUT_SQL)
def q_row_batches_recut(spark, sf_dir):
    """A cut over an older, finer cut leaves none of its batches."""
    numbered = B.number_rows(oc(spark, sf_dir))  # both cuts share the order
    path = work_dir(spark, "batches")
    B.write_batches(B.split_row_batches(numbered, BATCH_SIZE // 2), path, in_order=True)
    B.write_batches(B.split_row_batches(numbered, BATCH_SIZE), path, in_order=True)
    return (B.read_batches(spark, path).groupBy("batch_id")
            .agg(F.count(F.lit(1)).alias("rows"), F.min("order_date").alias("first_date"),
                 F.max("order_date").alias("last_date")))


@register("read_batch", with_oc(f"""
SELECT order_id, product_id, order_date
FROM (SELECT *, CAST(({ROWNUM_SQL} - 1) // {BATCH_SIZE} AS INTEGER) AS batch_id FROM oc) WHERE batch_id = 7"""))
def q_read_batch(spark, sf_dir):
    """One batch of the cut of the whole fact, read by its folder and statistics."""
    path = work_dir(spark, "batches")
    B.write_batches(B.split_row_batches(oc(spark, sf_dir), BATCH_SIZE), path, in_order=True)
    return B.read_batch(spark, path, 7).select("order_id", "product_id", "order_date")


@register("check_batches_damaged", with_oc(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total_batches, CAST(SUM(rows) AS BIGINT) AS total_rows, MIN(batch_id) AS first_id,
       CAST(MAX(batch_id) - MIN(batch_id) + 1 - COUNT(*) AS BIGINT) AS gaps,
       CAST(COUNT(*) FILTER (WHERE rows = 0) AS BIGINT) AS empty_batches,
       CAST(COUNT(*) FILTER (WHERE batch_id < (SELECT MAX(batch_id) FROM sizes) AND rows <> {BATCH_SIZE}) AS BIGINT) AS wrong_size,
       CAST(MAX(CASE WHEN batch_id = (SELECT MAX(batch_id) FROM sizes) THEN rows END) AS BIGINT) AS last_batch_size,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM oc) AS source_rows,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM bad WHERE batch_id % 11 = 10) AS invalid_names,
       COUNT(*) > 0 AND MIN(batch_id) = 0 AND MAX(batch_id) + 1 = COUNT(*) AND SUM(rows) = (SELECT COUNT(*) FROM oc)
         AND (SELECT COUNT(*) FROM bad WHERE batch_id % 11 = 10) = 0 AS passed
FROM sizes""", f"""
bad AS (SELECT * FROM (SELECT CAST((rn - 1) // {BATCH_SIZE} AS INTEGER) AS batch_id, rn FROM (SELECT {ROWNUM_SQL} AS rn FROM oc))
        WHERE batch_id % 7 <> 3 AND (batch_id % 5 <> 1 OR rn % 2 = 0)),
sizes AS (SELECT batch_id, COUNT(*) AS rows FROM bad WHERE batch_id % 11 <> 10 GROUP BY batch_id)"""))
def q_check_batches_damaged(spark, sf_dir):
    """V2 over a damaged cut: missing batches, short ones, rows without a batch index."""
    from shoplens.functions.numbering import global_row_number

    fact = oc(spark, sf_dir)
    rows = global_row_number(fact, B.BATCH_ORDER, "rn").withColumn("batch_id", F.floor((F.col("rn") - 1) / BATCH_SIZE).cast("int"))
    bad = rows.where((F.col("batch_id") % 7 != 3) & ((F.col("batch_id") % 5 != 1) | (F.col("rn") % 2 == 0)))
    return V.check_batches(bad.withColumn("batch_id", F.when(F.col("batch_id") % 11 != 10, F.col("batch_id"))), fact, BATCH_SIZE)


@register("check_batch_files", with_oc("""
SELECT CAST(COUNT(*) + 1 AS BIGINT) AS total_batches, CAST(SUM(rows) AS BIGINT) AS total_rows, MIN(batch_id) AS first_id,
       CAST(0 AS BIGINT) AS gaps, CAST(1 AS BIGINT) AS empty_batches,
       CAST(0 AS BIGINT) AS last_batch_size, (SELECT CAST(COUNT(*) AS BIGINT) FROM oc) AS source_rows
FROM m""", """
m AS (SELECT DENSE_RANK() OVER (ORDER BY strftime(order_date, '%Y-%m')) - 1 AS batch_id, COUNT(*) AS rows
      FROM oc GROUP BY strftime(order_date, '%Y-%m'))"""))
def q_check_batch_files(spark, sf_dir):
    """V2 and the file-name index over ``batch_<n>.csv`` files: one file a month, and a last one without a row."""
    fact = oc(spark, sf_dir).withColumn("m", F.date_format("order_date", "yyyy-MM"))
    out = work_dir(spark, "batch_files")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = f"{out}-parts"
    (fact.select(*CLEAN_COLUMNS, "m").repartition("m").write.partitionBy("m").option("header", True).csv(parts))
    root = fs.Path(parts).getFileSystem(conf)
    root.mkdirs(fs.Path(out))
    months = sorted(s.getPath().getName() for s in root.listStatus(fs.Path(parts)) if s.getPath().getName().startswith("m="))
    for k, m in enumerate(months):  # a file a month of the calendar
        file = [s.getPath() for s in root.listStatus(fs.Path(f"{parts}/{m}")) if s.getPath().getName().startswith("part-")][0]
        root.rename(file, fs.Path(f"{out}/batch_{k}.csv"))
    root.create(fs.Path(f"{out}/batch_{len(months)}.csv")).close()
    return V.check_batch_files(spark, out, fact, None).select(
        "total_batches", "total_rows", "first_id", "gaps", "empty_batches", "last_batch_size", "source_rows")


@register("create_table", with_oc("""
SELECT strftime(order_date, '%Y-%m') AS month, CAST(COUNT(*) AS BIGINT) AS rows FROM oc GROUP BY 1"""))
def q_create_table(spark, sf_dir):
    """The table over a folder that already holds the whole clean fact."""
    name = "clean_" + uuid.uuid4().hex[:12]
    path = work_dir(spark, "create_table")
    write_clean(oc(spark, sf_dir), path, by_month=True)
    rows = create_table(spark, name, path).groupBy(F.date_format("order_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"))
    found = materialize(rows, "create_table_rows")
    spark.sql(f"DROP TABLE {name}")  # the folder stays: the table is external
    return found


REVIEWS_PER_FILE = 100_000


@register("orders_clean_from_csv", with_oc(f"SELECT {', '.join(CLEAN_COLUMNS)} FROM oc"))
def q_orders_clean_from_csv(spark, sf_dir):
    """The raw tables as CSV files, review rows with whole document texts
    (quotes and line ends) as comments, read back and cleaned."""
    raw = raw_from_testdata(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    n = docs.count()
    comments = docs.select(F.col("doc_id").alias("k"), F.concat(F.lit('a "quoted" word, and:\n'), "text").alias("review_comment_message"))
    reviews = raw["reviews"].withColumn("k", F.pmod(F.col("order_id").cast("long"), F.lit(max(1, n))))
    # each review repeats a whole text: a merge join leaves rows of one text together, so that
    # compression takes the repeats out; a file holds a bounded number of reviews
    reviews = reviews.repartition(-(-reviews.count() // REVIEWS_PER_FILE) or 1, "k")
    raw["reviews"] = reviews.join(comments.hint("merge"), "k", "left").select("order_id", "review_comment_message", "review_score")
    base = work_dir(spark, "raw_csv")
    for name, df in raw.items():
        (df.write.option("header", True).option("escape", '"').option("quoteAll", name == "reviews")
         .option("compression", "gzip" if name == "reviews" else "none").csv(f"{base}/{RAW_FILES[name]}"))
    return C.build_orders_clean(read_raw(spark, base))


@register("check_table", with_oc("""
SELECT CAST((SELECT COUNT(*) FROM oc) AS BIGINT) AS row_count,
       CAST(COUNT(*) AS BIGINT) AS duplicate_pk_groups
FROM (SELECT order_id FROM oc GROUP BY order_id, product_id, order_date HAVING COUNT(*) > 1)"""))
def q_check_table(spark, sf_dir):
    return V.check_table(oc(spark, sf_dir))


@register("upsert_changes", with_oc("""
SELECT order_id, customer_id, product_id, order_date,
       CAST(CASE WHEN changed THEN price + 1 ELSE price END AS DECIMAL(18,2)) AS price,
       freight_value, payment_value, CASE WHEN changed THEN 5 ELSE review_score END AS review_score,
       product_category_name, customer_city, customer_state
FROM t WHERE NOT late OR changed
UNION ALL
SELECT order_id, customer_id, product_id || '-n', order_date, price, freight_value, payment_value, review_score,
       product_category_name, customer_city, customer_state FROM t WHERE changed""", """
t AS (SELECT *, CAST(order_id AS BIGINT) % 10 = 0 AS changed, strftime(order_date, '%Y') = '1998' AS late FROM oc)"""))
def q_upsert_changes(spark, sf_dir):
    """Every tenth order updated, and as many new keys, over all months; the
    target lacks a whole year of them. Applied a second time (replay)."""
    fact = oc(spark, sf_dir).select(*CLEAN_COLUMNS)
    target = work_dir(spark, "upsert-target")
    write_clean(fact.where(F.date_format("order_date", "yyyy") != "1998"), target, by_month=True)
    touched = fact.where(F.col("order_id").cast("bigint") % 10 == 0)
    changed = touched.withColumn("price", (F.col("price") + 1).cast("decimal(18,2)")).withColumn(
        "review_score", F.lit(5))
    new_rows = touched.withColumn("product_id", F.concat("product_id", F.lit("-n")))
    batch = changed.unionByName(new_rows)
    upsert(spark, target, batch)
    upsert(spark, target, batch)  # replay: same result
    return read_clean(spark, target, keep_partition=False)


STREAM_BATCH_SIZE = 20000


@register("stream_ingest", with_oc(f"SELECT {', '.join(CLEAN_COLUMNS)} FROM oc"))
def q_stream_ingest(spark, sf_dir):
    """X1..X3: cut the clean fact into batches, stream them through P8 into the
    log, merge it into an empty table (S7), return the table."""
    fact = oc(spark, sf_dir).select(*CLEAN_COLUMNS)
    batch_dir = work_dir(spark, "stream-batches")
    numbered = B.number_rows(fact)
    B.write_batches(B.split_row_batches(numbered, STREAM_BATCH_SIZE), batch_dir)
    remove_path(spark, numbered.written_at)
    target, ckpt = work_dir(spark, "stream-target"), work_dir(spark, "stream-ckpt")
    ingest(spark, batch_dir, target, ckpt, files_per_trigger=1)
    return read_clean(spark, target, keep_partition=False)


@register("stream_progress", with_oc(f"""
SELECT batch_id, CAST(COUNT(*) AS BIGINT) AS rows, CAST(COUNT(*) AS BIGINT) AS consumed,
       (SELECT CAST((COUNT(*) - 1) // 1000 + 1 AS INTEGER) FROM oc) AS pointer
FROM (SELECT CAST(({ROWNUM_SQL} - 1) // {BATCH_SIZE} AS INTEGER) AS batch_id FROM oc) GROUP BY batch_id"""))
def q_stream_progress(spark, sf_dir):
    """Rows consumed of each batch and the pointer, after an ingest at four
    files per trigger and a second run that finds nothing new."""
    batch_dir, target, ckpt = (work_dir(spark, f"progress-{x}") for x in ("batches", "target", "ckpt"))
    B.write_batches(B.split_row_batches(oc(spark, sf_dir), BATCH_SIZE), batch_dir)
    ingest(spark, batch_dir, target, ckpt, files_per_trigger=4)
    pointer = ingest(spark, batch_dir, target, ckpt, files_per_trigger=4)
    return batch_progress(spark, batch_dir, ckpt).withColumn("pointer", F.lit(pointer))


@register("live_kpis", with_oc("""
SELECT date, total_revenue, order_count, CAST(SUM(order_count) OVER (ORDER BY date) AS BIGINT) AS cumulative_orders
FROM (SELECT CAST(order_date AS DATE) AS date, CAST(SUM(payment_value) AS DOUBLE) AS total_revenue,
             CAST(COUNT(*) AS BIGINT) AS order_count FROM oc GROUP BY 1)"""))
def q_live_kpis(spark, sf_dir):
    """A4, A5, W1 of a stream whose later batches overwrite keys of earlier ones, the
    overwriting ones first; then restarted for batches that came meanwhile."""
    from shoplens.streaming.kpis import kpi_stream, live_daily

    fact = oc(spark, sf_dir).select(*CLEAN_COLUMNS)
    batch_dir, ckpt = work_dir(spark, "live-batches"), work_dir(spark, "live-ckpt")
    order = F.col("order_id").cast("bigint")
    put = lambda df, k: (df.withColumn("batch_id", F.lit(k)).withColumn("batch_range", F.lit(k))
                         .write.mode("append").partitionBy("batch_range").parquet(batch_dir))
    put(fact.where(order % 3 == 0), 5)
    kpi_stream(spark, batch_dir, ckpt).awaitTermination()
    put(fact.where(order % 6 == 0).withColumn("payment_value", (F.col("payment_value") * 2).cast("decimal(18,2)")), 1)  # late, older
    put(fact.where(order % 3 == 1).withColumn("payment_value", (F.col("payment_value") + 7).cast("decimal(18,2)")), 2)  # will be corrected
    kpi_stream(spark, batch_dir, ckpt, files_per_trigger=100).awaitTermination()
    put(fact.where(order % 3 != 0), 6)
    kpi_stream(spark, batch_dir, ckpt, files_per_trigger=100).awaitTermination()
    return live_daily(spark, ckpt)


# ---- forecast ------------------------------------------------------------------------------

_MODEL_CACHE: dict = {}


def training_frames(spark, sf_dir):
    """(split features, next-day features) for the whole series."""
    fact = oc(spark, sf_dir)
    series = TS.daily_series(fact)
    split = TS.time_split(TS.clean_training(TS.time_features(series)))
    return split, TS.next_day_features(series)


def trained(spark, sf_dir):
    """F6 once per session and data folder; the model is saved (F12) and reloaded."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _MODEL_CACHE:
        path = work_dir(spark, "model")
        split, nxt = training_frames(spark, sf_dir)
        # one row per day: written once instead of being derived from the fact by each query
        split, nxt = materialize(split.coalesce(1), "split"), materialize(nxt, "next_day")
        FC.train_and_save(oc(spark, sf_dir), path, split)
        _MODEL_CACHE[key] = (path, split, nxt)
    path, split, nxt = _MODEL_CACHE[key]
    return FC.load_model(spark, path), split, nxt, path


BASELINE_SQL = """
SELECT ROUND_EVEN(AVG(ABS(daily_revenue - lag_1)), 6) AS baseline_mae,
       ROUND_EVEN(SQRT(AVG((daily_revenue - lag_1) * (daily_revenue - lag_1))), 6) AS baseline_rmse,
       ROUND_EVEN(COALESCE(AVG(CASE WHEN daily_revenue <> 0 THEN ABS((daily_revenue - lag_1) / daily_revenue) END)
                           * 100.0, 0.0), 6) AS baseline_mape,
       CAST(COUNT(*) AS BIGINT) AS test_rows
FROM (SELECT daily_revenue, lag_1, ROW_NUMBER() OVER (ORDER BY date) AS position, COUNT(*) OVER () AS n
      FROM features WHERE daily_revenue IS NOT NULL)
WHERE NOT (n < 5 OR position <= LEAST(GREATEST(FLOOR(n * 0.8), 1), n - 1))"""


@register("baseline_metrics", with_oc(BASELINE_SQL, FEATURES_CTE))
def q_baseline_metrics(spark, sf_dir):
    """F7's lag_1 baseline on the test days (no model needed, SQL-checkable)."""
    split, _ = training_frames(spark, sf_dir)
    test = split.where(F.col("split") == "test")
    y, b = F.col(TARGET_COLUMN), F.col("lag_1")
    e = y - b
    return test.agg(F.bround(F.avg(F.abs(e)), 6).alias("baseline_mae"),
                    F.bround(F.sqrt(F.avg(e * e)), 6).alias("baseline_rmse"),
                    F.bround(F.coalesce(F.avg(F.when(y != 0, F.abs(e / y))) * 100.0, F.lit(0.0)), 6)
                    .alias("baseline_mape"),
                    F.count(F.lit(1)).cast("bigint").alias("test_rows"))


@register("forecast_metrics")
def q_forecast_metrics(spark, sf_dir):
    """F6 + F7 + F12: metrics stored with the model, read back."""
    _, _, _, path = trained(spark, sf_dir)
    return FC.load_metrics(spark, path)


def by_mean(rows):
    """A fixed prediction in place of the model's: the mean of the last seven days."""
    return rows.withColumn("prediction", F.col("rolling_mean_7"))


SCORED_CTE = FEATURES_CTE + """,
numbered_days AS (SELECT *, ROW_NUMBER() OVER (ORDER BY date) AS position, COUNT(*) OVER () AS n
                  FROM features WHERE daily_revenue IS NOT NULL),
parts AS (SELECT *, n < 5 OR position <= LEAST(GREATEST(FLOOR(n * 0.8), 1), n - 1) AS train FROM numbered_days),
scored AS (SELECT AVG(ABS(daily_revenue - rolling_mean_7)) AS mae,
                  SQRT(AVG((daily_revenue - rolling_mean_7) * (daily_revenue - rolling_mean_7))) AS rmse,
                  COALESCE(AVG(CASE WHEN daily_revenue <> 0 THEN ABS((daily_revenue - rolling_mean_7) / daily_revenue) END) * 100, 0) AS mape,
                  AVG(ABS(daily_revenue - lag_1)) AS baseline_mae,
                  STDDEV_POP(daily_revenue - rolling_mean_7) AS residual_std, COUNT(*) AS test_rows
           FROM parts WHERE NOT train),
next_day AS (SELECT MAX(date) + 1 AS date FROM series),
last_mean AS (SELECT AVG(daily_revenue) AS p FROM series WHERE date > (SELECT MAX(date) - 7 FROM series)),
train_mean AS (SELECT AVG(rolling_mean_7) AS m, COUNT(*) AS training_rows FROM parts WHERE train)"""


@register("forecast_metrics_fixed", with_oc("""
SELECT ROUND_EVEN(mae, 6) AS mae, ROUND_EVEN(rmse, 6) AS rmse, ROUND_EVEN(mape, 6) AS mape,
       ROUND_EVEN((baseline_mae - mae) / baseline_mae * 100, 6) AS baseline_improvement_pct,
       ROUND_EVEN(residual_std, 6) AS residual_std, CAST(training_rows AS BIGINT) AS training_rows,
       CAST(test_rows AS BIGINT) AS test_rows FROM scored, train_mean""", SCORED_CTE))
def q_forecast_metrics_fixed(spark, sf_dir):
    """F7 with a fixed prediction, which SQL can follow."""
    split, _ = training_frames(spark, sf_dir)
    return round_doubles(FC.forecast_metrics(by_mean, split).select(
        "mae", "rmse", "mape", "baseline_improvement_pct", "residual_std", "training_rows", "test_rows"))


@register("next_day_prediction_fixed", with_oc("""
SELECT date, ROUND_EVEN(p, 6) AS predicted_revenue, ROUND_EVEN(GREATEST(p - residual_std, 0), 6) AS lower_bound,
       ROUND_EVEN(p + residual_std, 6) AS upper_bound FROM next_day, last_mean, scored""", SCORED_CTE))
def q_next_day_prediction_fixed(spark, sf_dir):
    """F8 with a fixed prediction."""
    split, nxt = training_frames(spark, sf_dir)
    return round_doubles(FC.predict_next(by_mean, nxt, FC.forecast_metrics(by_mean, split)))


@register("occlusion_drivers_fixed", with_oc("""
SELECT 'rolling_mean_7' AS feature, ROUND_EVEN(p, 6) AS value, ROUND_EVEN(p - m, 6) AS impact
FROM last_mean, train_mean""", SCORED_CTE))
def q_occlusion_drivers_fixed(spark, sf_dir):
    """Drivers of a fixed prediction by occlusion: only the mean itself drives it."""
    split, nxt = training_frames(spark, sf_dir)
    drivers = FC.occlusion_drivers(by_mean, nxt, split.where(F.col("split") == "train"))
    return round_doubles(drivers.where("impact <> 0"))


# a fixed model: base 100 and two trees, one of which asks lag_1 twice on a path
_F = FEATURE_COLUMNS.index
FIXED_NODES = [
    (0, 1, None, None, 100.0, 100.0),
    (1, 1, _F("day_of_week"), 4.5, 100.0, None), (1, 2, _F("lag_1"), 5e6, 70.0, None), (1, 3, _F("day_of_month"), 15.5, 30.0, None),
    (1, 4, None, None, 40.0, 10.0), (1, 5, None, None, 30.0, -4.0), (1, 6, None, None, 12.0, 7.0), (1, 7, None, None, 18.0, -20.0),
    (2, 1, _F("lag_1"), 3e6, 100.0, None), (2, 2, _F("lag_1"), 1e6, 25.0, None), (2, 3, _F("month"), 6.5, 75.0, None),
    (2, 4, None, None, 5.0, 3.0), (2, 5, None, None, 20.0, 1.5), (2, 6, None, None, 50.0, -2.0), (2, 7, None, None, 25.0, 8.25)]


def fixed_forest(spark):
    from shoplens.plans.boosting import NODE_FIELDS

    return spark.createDataFrame(FIXED_NODES, NODE_FIELDS)


def game_cte(rows: str) -> str:
    """Shapley values of the fixed model from the definition: the value of every
    set of its four features, and the mean gain of a feature over all sets."""
    known = lambda bit, cond, share: f"CASE WHEN s & {bit} > 0 THEN CAST({cond} AS DOUBLE) ELSE {share} END"
    dow, dom = known(1, "(day_of_week <= 4.5)::INT", "0.7"), known(2, "(day_of_month <= 15.5)::INT", "12 / 30.0")
    month = known(4, "(month <= 6.5)::INT", "50 / 75.0")
    lag = lambda at, share: known(8, f"(lag_1 <= {at})::INT", share)
    return f"""
share AS (SELECT r.date, r.day_of_week, r.day_of_month, r.month, r.lag_1, s, {dow} AS dow, {dom} AS dom, {month} AS mon,
                 {lag('5e6', '40 / 70.0')} AS l5, {lag('3e6', '0.25')} AS l3, {lag('1e6', '5 / 25.0')} AS l1
          FROM ({rows}) r CROSS JOIN (SELECT UNNEST(range(16)) AS s)),
game AS (SELECT *, 100 + dow * (l5 * 10 + (1 - l5) * -4) + (1 - dow) * (dom * 7 + (1 - dom) * -20)
                   + l3 * (l1 * 3 + (1 - l1) * 1.5) + (1 - l3) * (mon * -2 + (1 - mon) * 8.25) AS v FROM share),
player AS (SELECT * FROM (VALUES (0, 'day_of_week', 0), (1, 'day_of_month', 1), (2, 'month', 2), (3, 'lag_1', 5)) t(bit, feature, idx)),
shap AS (SELECT a.date, p.feature, p.idx,
                SUM((b.v - a.v) * CASE bit_count(a.s) WHEN 0 THEN 1 / 4.0 WHEN 1 THEN 1 / 12.0 WHEN 2 THEN 1 / 12.0 ELSE 1 / 4.0 END) AS impact
         FROM game a CROSS JOIN player p JOIN game b ON a.date = b.date AND (a.s >> p.bit) % 2 = 0 AND b.s = a.s + (1 << p.bit)
         GROUP BY a.date, p.feature, p.idx)"""


_USED = "('day_of_week', 'day_of_month', 'month', 'lag_1')"
_UNUSED = [f for f in FEATURE_COLUMNS if f not in _USED]
DAYS_CTE = FEATURES_CTE + """,
numbered_days AS (SELECT *, ROW_NUMBER() OVER (ORDER BY date) AS position, COUNT(*) OVER () AS n
                  FROM features WHERE daily_revenue IS NOT NULL),
parts AS (SELECT *, n < 5 OR position <= LEAST(GREATEST(FLOOR(n * 0.8), 1), n - 1) AS train FROM numbered_days)"""


@register("feature_importance_fixed", with_oc(f"""
SELECT feature, ROUND_EVEN(AVG(ABS(impact)), 6) AS mean_abs_shap FROM shap GROUP BY feature
UNION ALL SELECT UNNEST({_UNUSED}), 0.0""", DAYS_CTE + "," + game_cte("SELECT * FROM parts WHERE train")))
def q_feature_importance_fixed(spark, sf_dir):
    """F9 of a fixed forest over the training days; SQL takes the definition."""
    split, _ = training_frames(spark, sf_dir)
    return round_doubles(FC.feature_importance(fixed_forest(spark), split.where(F.col("split") == "train")))


@register("prediction_drivers_fixed", with_oc(f"""
SELECT feature, ROUND_EVEN(CASE feature WHEN 'day_of_week' THEN day_of_week WHEN 'day_of_month' THEN day_of_month
                                        WHEN 'month' THEN month ELSE lag_1 END, 6) AS value, ROUND_EVEN(impact, 6) AS impact
FROM shap JOIN nf USING (date) WHERE impact <> 0 ORDER BY ABS(impact) DESC, idx LIMIT 4""", NEXT_DAY_CTE + """,
nf AS (SELECT date, CAST(isodow(date) - 1 AS DOUBLE) AS day_of_week, CAST(dayofmonth(date) AS DOUBLE) AS day_of_month,
              CAST(month(date) AS DOUBLE) AS month, v1 AS lag_1 FROM nd),""" + game_cte("SELECT * FROM nf")))
def q_prediction_drivers_fixed(spark, sf_dir):
    """F10 of a fixed forest for the next day; SQL takes the definition."""
    _, nxt = training_frames(spark, sf_dir)
    return round_doubles(FC.prediction_drivers(fixed_forest(spark), nxt, 4).where("impact <> 0"))


@register("model_roundtrip", with_oc("""
SELECT date, CAST(ROUND_EVEN(p, 6) AS DOUBLE) AS prediction, ROUND_EVEN(AVG(ABS(daily_revenue - p)) OVER (), 4) AS mae,
       CAST(COUNT(*) OVER () AS BIGINT) AS test_rows
FROM (SELECT date, daily_revenue,
             100 + CASE WHEN day_of_week <= 4.5 THEN CASE WHEN lag_1 <= 5e6 THEN 10 ELSE -4 END
                        ELSE CASE WHEN day_of_month <= 15.5 THEN 7 ELSE -20 END END
                 + CASE WHEN lag_1 <= 3e6 THEN CASE WHEN lag_1 <= 1e6 THEN 3 ELSE 1.5 END
                        ELSE CASE WHEN month <= 6.5 THEN -2 ELSE 8.25 END END AS p FROM parts WHERE NOT train)""", DAYS_CTE))
def q_model_roundtrip(spark, sf_dir):
    """a fixed model and its metrics saved, loaded, and used on the test days."""
    split, _ = training_frames(spark, sf_dir)
    split, nodes, path = materialize(split.coalesce(1), "split"), fixed_forest(spark), work_dir(spark, "fixed-model")
    FC.save_model(nodes, FC.forecast_metrics(FC.by_model(nodes), split),
                  FC.feature_importance(nodes, split.where(F.col("split") == "train")), path)
    scored = FC.by_model(FC.load_model(spark, path))(split.where(F.col("split") == "test"))
    metrics = FC.load_metrics(spark, path).select(F.bround("mae", 4).alias("mae"), "test_rows")
    return scored.select("date", F.bround("prediction", 6).alias("prediction")).crossJoin(F.broadcast(metrics))


@register("attributions_add_up", with_oc("SELECT CAST(COUNT(*) AS BIGINT) AS days, CAST(0 AS BIGINT) AS off FROM parts", DAYS_CTE))
def q_attributions_add_up(spark, sf_dir):
    """F9 of the trained model over all days: a day's attributions and the
    expected value are its prediction, to one part in 10^9."""
    from shoplens.plans import attribution as AT

    nodes, split, _, _ = trained(spark, sf_dir)
    sums = AT.attributions(nodes, split, [], FEATURE_COLUMNS).groupBy("date").agg(F.sum("impact").alias("impacts"))
    both = (FC.by_model(nodes)(split).select("date", "prediction").join(sums, "date")
            .crossJoin(F.broadcast(AT.expected_value(nodes, []))))
    gap = F.abs(F.col("prediction") - F.col("impacts") - F.col("expected"))
    return both.agg(F.count(F.lit(1)).alias("days"), F.count(F.when(gap > 1e-9 * F.abs("prediction"), 1)).alias("off"))


def state_frames(spark, sf_dir):
    """(split features, next-day features) of every state."""
    keys = ["customer_state"]
    series = TS.daily_series(oc(spark, sf_dir), keys)
    split = TS.time_split(TS.clean_training(TS.time_features(series, keys), keys), keys)
    return split, TS.next_day_features(series, keys)


STATE_METRICS = ["mae", "rmse", "mape", "baseline_improvement_pct", "residual_std", "training_rows", "test_rows"]


@register("state_forecast_metrics_fixed", with_oc("""
SELECT customer_state, ROUND_EVEN(COALESCE(mae, 0), 6) AS mae, ROUND_EVEN(COALESCE(rmse, 0), 6) AS rmse,
       ROUND_EVEN(COALESCE(mape, 0), 6) AS mape,
       ROUND_EVEN(CASE WHEN baseline_mae > 0 THEN (baseline_mae - mae) / baseline_mae * 100 ELSE 0 END, 6) AS baseline_improvement_pct,
       ROUND_EVEN(COALESCE(residual_std, 0), 6) AS residual_std, training_rows, test_rows
FROM (SELECT customer_state, AVG(ABS(e)) AS mae, SQRT(AVG(e * e)) AS rmse,
             AVG(CASE WHEN daily_revenue <> 0 THEN ABS(e / daily_revenue) END) * 100 AS mape, AVG(ABS(b)) AS baseline_mae,
             STDDEV_POP(e) AS residual_std, CAST(COUNT(*) - COUNT(e) AS BIGINT) AS training_rows, CAST(COUNT(e) AS BIGINT) AS test_rows
      FROM (SELECT *, CASE WHEN NOT train THEN daily_revenue - rolling_mean_7 END AS e,
                   CASE WHEN NOT train THEN daily_revenue - lag_1 END AS b FROM sparts) GROUP BY customer_state)""",
    STATE_SERIES_CTE + "," + features_cte("sseries", "customer_state", "s") + """,
snum AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_state ORDER BY date) AS position,
                COUNT(*) OVER (PARTITION BY customer_state) AS n FROM sfeatures WHERE daily_revenue IS NOT NULL),
sparts AS (SELECT *, n < 5 OR position <= LEAST(GREATEST(FLOOR(n * 0.8), 1), n - 1) AS train FROM snum)"""))
def q_state_forecast_metrics_fixed(spark, sf_dir):
    """F7 of every state with a fixed prediction."""
    split, _ = state_frames(spark, sf_dir)
    return round_doubles(FC.forecast_metrics(by_mean, split, ["customer_state"]).select("customer_state", *STATE_METRICS))


@register("state_forecast")
def q_state_forecast(spark, sf_dir):
    """F6, F7, F8 of every state: a model each, all trained by one job."""
    keys = ["customer_state"]
    split, nxt = state_frames(spark, sf_dir)
    split = materialize(split, "state_split")
    nodes = FC.train_forecast(split, keys)
    metrics = materialize(FC.forecast_metrics(FC.by_model(nodes, keys), split, keys), "state_metrics")
    return FC.predict_next(FC.by_model(nodes, keys), nxt, metrics, keys).join(metrics.select(*keys, *STATE_METRICS), keys)


@register("next_day_prediction")
def q_next_day_prediction(spark, sf_dir):
    """F8."""
    model, _, nxt, path = trained(spark, sf_dir)
    return FC.predict_next(FC.by_model(model), nxt, FC.load_metrics(spark, path))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """mean size of the Shapley values over the training days."""
    _, _, _, path = trained(spark, sf_dir)
    return FC.load_importance(spark, path)


@register("top_importances")
def q_top_importances(spark, sf_dir):
    """K7: the five most important features."""
    _, _, _, path = trained(spark, sf_dir)
    return FC.load_importance(spark, path, 5)


@register("prediction_drivers")
def q_prediction_drivers(spark, sf_dir):
    """top-5 drivers of the next-day prediction."""
    model, _, nxt, _ = trained(spark, sf_dir)
    return FC.prediction_drivers(model, nxt)


# ---- presentation relations ---------------------------------------------------------------

@register("top_categories_chart", with_oc("""
SELECT REPLACE(product_category_name, '_', ' ') AS category, CAST(COALESCE(SUM(payment_value), 0) AS DOUBLE) AS revenue
FROM oc GROUP BY product_category_name ORDER BY revenue DESC, product_category_name LIMIT 10"""))
def q_top_categories_chart(spark, sf_dir):
    return P.top_categories_chart(M.category_analysis(oc(spark, sf_dir)))


@register("top_states_chart", with_oc("""
SELECT CASE WHEN rk = 1 THEN state || ' (Top)' ELSE state END AS state, revenue, CAST(rk AS INTEGER) AS rank
FROM (SELECT state, revenue, ROW_NUMBER() OVER (ORDER BY revenue DESC, state) AS rk
      FROM (SELECT customer_state AS state, CAST(COALESCE(SUM(payment_value), 0) AS DOUBLE) AS revenue
            FROM oc GROUP BY customer_state))
WHERE rk <= 10"""))
def q_top_states_chart(spark, sf_dir):
    return P.top_states_chart(M.geo_analysis(oc(spark, sf_dir)))


@register("weekday_chart", with_oc("""
SELECT CAST(dayofweek(order_date) AS INTEGER) AS day,
       ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][dayofweek(order_date) + 1] AS label,
       COALESCE(CAST(SUM(payment_value) AS DOUBLE) / COUNT(payment_value), 0.0) AS avg_revenue
FROM oc GROUP BY 1, 2"""))
def q_weekday_chart(spark, sf_dir):
    return P.weekday_chart(M.weekday_analysis(oc(spark, sf_dir)))


@register("latest_anomalies", with_oc("""
SELECT date, ROUND_EVEN(daily_revenue, 6) AS revenue, ROUND_EVEN((daily_revenue - mu) / sd, 6) AS z_score
FROM series CROSS JOIN (SELECT AVG(daily_revenue) AS mu, STDDEV_POP(daily_revenue) AS sd FROM series)
WHERE sd <> 0 AND ABS((daily_revenue - mu) / sd) > 2.5 ORDER BY date DESC LIMIT 3""", SERIES_CTE))
def q_latest_anomalies(spark, sf_dir):
    return round_doubles(P.latest_anomalies(TS.detect_anomalies(TS.daily_series(oc(spark, sf_dir)))))


@register("segment_shares", with_oc("""
SELECT segment, segment_order, count,
       CAST(CASE WHEN total > 0 THEN FLOOR(count * 100.0 / total + 0.5) END AS INTEGER) AS share_pct
FROM (SELECT *, SUM(count) OVER () AS total FROM (""" + SEGMENTS_BODY.replace("ORDER BY segment_order", "") + "))",
                                    SEGMENTS_SQL.format(where="")))
def q_segment_shares(spark, sf_dir):
    return P.segment_shares(M.customer_segments(oc(spark, sf_dir)))


@register("retention_bands", with_oc("""
SELECT cohort_month, period_number, retention_pct,
       CASE WHEN retention_pct >= 75 THEN 'very_high' WHEN retention_pct >= 50 THEN 'high'
            WHEN retention_pct >= 25 THEN 'medium' WHEN retention_pct > 0 THEN 'low' ELSE 'none' END AS band
FROM long WHERE cohort_month IN (SELECT DISTINCT cohort_month FROM long ORDER BY cohort_month LIMIT 12)""",
                                     COHORT_CTE))
def q_retention_bands(spark, sf_dir):
    return P.retention_bands(A.cohort_retention_long(orders7(spark, sf_dir)))


@register("top_root_causes", with_oc("""
SELECT c.order_day AS date, top_category, category_increase_pct, top_state, state_increase_pct
FROM category_res c JOIN state_res s ON c.order_day = s.order_day ORDER BY date LIMIT 5""", ROOT_CAUSE_CTE))
def q_top_root_causes(spark, sf_dir):
    """K7: the first five anomaly explanations."""
    return P.first_n(A.anomaly_root_cause(orders7(spark, sf_dir)), ["date"], 5)


# ---- marts bundle ---------------------------------------------------------------------------

BUNDLE = ["metrics", "daily_revenue", "daily_orders", "data_growth", "anomalies", "category_analysis",
          "customer_segments", "weekday_analysis", "insights", "recommendations", "geo_analysis", "cohort_retention",
          "revenue_decomposition", "churn_risk", "anomaly_root_cause", "customer_ltv", "filter_summary"]
#: rows of the tables that come from a trained model
TRAINED = {"prediction": 1, "model_metrics": 1, "prediction_explanation": 5}
BUNDLE_SQL = "\nUNION ALL\n".join(
    [f"SELECT '{name}' AS mart, 'ok' AS status, CAST(COUNT(*) AS BIGINT) AS rows FROM ({ORACLE[name]})" for name in BUNDLE]
    + [f"SELECT '{name}', 'ok', CAST({n} AS BIGINT)" for name, n in TRAINED.items()])


@register("marts_bundle", BUNDLE_SQL)
def q_marts_bundle(spark, sf_dir):
    """Every table written, those of the trained model too; returns each one's status and rows."""
    out, (_, _, _, model) = work_dir(spark, "marts"), trained(spark, sf_dir)
    return BU.mart_status(spark, out, BU.materialize_marts(spark, oc(spark, sf_dir), out, model))


@register("refresh_after_ingest", with_oc("""
SELECT CAST(COUNT(*) AS BIGINT) AS total_orders, CAST(COALESCE(SUM(payment_value), 0) AS DOUBLE) AS total_revenue,
       CAST(1 AS BIGINT) AS predictions, CAST(5 AS BIGINT) AS drivers FROM oc"""))
def q_refresh_after_ingest(spark, sf_dir):
    """The tables that the refresh wrote after an ingest of the whole fact, with a model trained on it."""
    from shoplens.streaming.loader import refresh_after_batch

    batch_dir, target, ckpt, marts, model = (work_dir(spark, f"refresh-{x}") for x in ("batches", "target", "ckpt", "marts", "model"))
    B.write_batches(B.split_row_batches(oc(spark, sf_dir).select(*CLEAN_COLUMNS), STREAM_BATCH_SIZE), batch_dir)
    ingest(spark, batch_dir, target, ckpt, on_compact=refresh_after_batch(marts_dir=marts, model_dir=model))
    rows = lambda name, column: spark.read.parquet(f"{marts}/{name}").agg(F.count(F.lit(1)).alias(column))
    return (spark.read.parquet(f"{marts}/metrics").crossJoin(F.broadcast(rows("prediction", "predictions")))
            .crossJoin(F.broadcast(rows("prediction_explanation", "drivers"))))


# corrections of two months, and new rows in them
CORRECTED = OC_SQL.strip().replace("oc AS (SELECT", "fact AS (SELECT") + """,
hit AS (SELECT * FROM fact WHERE strftime(order_date, '%Y-%m') IN ('1997-03', '1997-05') AND CAST(order_id AS BIGINT) % 3 = 0),
oc AS (SELECT f.* REPLACE (CASE WHEN strftime(order_date, '%Y-%m') IN ('1997-03', '1997-05') AND CAST(order_id AS BIGINT) % 3 = 0
                                THEN CAST(payment_value * 2 AS DECIMAL(18,2)) ELSE payment_value END AS payment_value) FROM fact f
       UNION ALL SELECT * REPLACE (order_id || '-n' AS order_id, customer_id || '-n' AS customer_id) FROM hit)"""
#: table -> (label, value) of its long form
LONG = {
    "metrics": ("'total_revenue'", "total_revenue"), "daily_revenue": ("CAST(date AS VARCHAR)", "total_revenue"),
    "daily_orders": ("CAST(date AS VARCHAR)", "order_count"), "data_growth": ("CAST(date AS VARCHAR)", "cumulative_orders"),
    "category_analysis": ("category", "revenue"), "geo_analysis": ("state", "revenue"), "weekday_analysis": ("CAST(day AS VARCHAR)", "avg_revenue"),
    "customer_segments": ("segment", "count"), "churn_risk": ("'high_risk'", "high_risk_customers"), "customer_ltv": ("customer_id", "total_spent"),
    "revenue_decomposition": ("'current_orders'", "current_orders"), "anomalies": ("CAST(date AS VARCHAR)", "revenue"),
    "anomaly_root_cause": ("CONCAT(top_category, top_state)", "category_increase_pct"), "filter_summary": ("max_date", "max_revenue")}


@register("incremental_marts", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS mart, {label} AS label, ROUND_EVEN(CAST({value} AS DOUBLE), 4) AS value FROM "
    f"({ORACLE[name].replace(OC_SQL.strip(), CORRECTED)})" for name, (label, value) in LONG.items()))
def q_incremental_marts(spark, sf_dir):
    """The marts merged from monthly partials, of which an upsert of corrections
    made two months anew; SQL computes them from the corrected fact."""
    from shoplens.plans import partials as PT

    fact = oc(spark, sf_dir).select(*CLEAN_COLUMNS)
    target, partials, out = (work_dir(spark, f"incremental-{x}") for x in ("target", "partials", "marts"))
    write_clean(fact, target, by_month=True)
    PT.refresh(spark, target, partials)
    hit = fact.where(F.date_format("order_date", "yyyy-MM").isin("1997-03", "1997-05") & (F.col("order_id").cast("bigint") % 3 == 0))
    new = hit.withColumns({"order_id": F.concat("order_id", F.lit("-n")), "customer_id": F.concat("customer_id", F.lit("-n"))})
    upsert(spark, target, hit.withColumn("payment_value", (F.col("payment_value") * 2).cast("decimal(18,2)")).unionByName(new))
    made = PT.refresh(spark, target, partials)
    if len(made) > 2:
        raise RuntimeError(f"more months than the upsert touched: {made}")
    BU.materialize_marts(spark, read_clean(spark, target), out, partials=partials)
    long = [spark.read.parquet(f"{out}/{name}").selectExpr(
        f"'{name}' AS mart", f"{label} AS label".replace("VARCHAR", "STRING"),
        f"bround(CAST({value} AS DOUBLE), 4) AS value") for name, (label, value) in LONG.items()]
    all_ = long[0]
    for df in long[1:]:
        all_ = all_.unionByName(df)
    return all_


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLE)
