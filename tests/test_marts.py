"""Marts, filters and signals on literal frames."""

from __future__ import annotations

from shoplens.operators import marts as M
from shoplens.operators import rules as R
from shoplens.operators import signals as G
from tests.frames import clean_frame, row


def sample(spark):
    return clean_frame(spark, [
        row("o1", "c1", "p1", "2024-01-06 10:00:00", 10, cat="a", state="X"),   # Saturday
        row("o1", "c1", "p2", "2024-01-06 10:00:00", 10, cat="b", state="X"),
        row("o2", "c2", "p1", "2024-01-08 09:00:00", 30, cat="a", state="Y"),   # Monday
        row("o3", "c3", "p3", "2024-01-09 23:59:59", 0, cat="b", state="Y"),    # Tuesday
    ])


def test_metrics_counts_item_rows_and_empty(spark):
    oc = sample(spark)
    m = M.metrics(oc).first()
    assert m.total_orders == 4 and m.total_revenue == 50.0
    e = M.metrics(oc, state="nowhere").first()
    assert e.total_orders == 0 and e.total_revenue == 0.0


def test_filter_truthiness(spark):
    oc = sample(spark)
    assert M.metrics(oc, category="", state="").first().total_orders == 4
    assert M.metrics(oc, min_revenue=0).first().total_orders == 4
    assert M.metrics(oc, max_revenue=0).first().total_orders == 1
    assert M.metrics(oc, start_date="2024-01-08", end_date="2024-01-09").first().total_orders == 2


def test_weekday_numbering_and_weekpart(spark):
    oc = sample(spark)
    days = {r.day: r.avg_revenue for r in M.weekday_analysis(oc).collect()}
    assert days == {6: 10.0, 1: 30.0, 2: 0.0}
    wp = G.weekpart_signal(oc).first()
    assert wp.weekend_avg == 10.0 and wp.weekday_avg == 15.0


def test_segments_always_three_rows(spark):
    seg = [(r.segment, r["count"]) for r in M.customer_segments(sample(spark)).collect()]
    assert [s for s, _ in seg] == ["High", "Medium", "Low"]
    assert sum(c for _, c in seg) == 3
    empty = M.customer_segments(sample(spark), state="none").collect()
    assert [(r.segment, r["count"]) for r in empty] == [("High", 0), ("Medium", 0), ("Low", 0)]


def test_filter_summary_empty(spark):
    r = M.filter_summary(sample(spark).where("1 = 0")).first()
    assert (r.min_date, r.max_date, r.min_revenue, r.max_revenue) == ("", "", 0.0, 0.0)


def test_category_ties_by_name(spark):
    cats = [r.category for r in M.category_analysis(sample(spark)).collect()]
    assert cats == ["a", "b"]  # 40 vs 10


def test_trend_uses_observed_day_ranks(spark):
    rows = [row(f"o{i}", "c", "p", f"2024-02-{i:02d}", 100 if i > 14 else 10) for i in range(1, 29, 2)]
    tr = G.trend_signal(clean_frame(spark, rows)).first()
    # 14 observed days (every other day): ranks 1-7 are the 7 latest observed days
    assert tr.last_7_avg == 100.0 and tr.previous_7_avg == 10.0


def test_insights_and_recommendations(spark):
    ctx = spark.createDataFrame(
        [(120.0, 100.0, 50.0, 40.0, "toys", 0.5, 2)],
        "last_7_avg double, previous_7_avg double, weekend_avg double, weekday_avg double, "
        "top_category string, top_category_share double, anomaly_count bigint")
    ins = [r.insight for r in R.insights(ctx).orderBy("position").collect()]
    assert ins == ["Revenue is trending upward 📈", "Weekend sales are higher than weekday sales",
                   "toys contributes the largest revenue share", "2 revenue anomalies need review ⚠️"]
    reco = [r.recommendation for r in R.recommendations(ctx).orderBy("position").collect()]
    assert reco == ["Focus promotions and ad spend on weekends",
                    "Expand inventory and merchandising around top-performing categories",
                    "Investigate revenue anomalies before scaling campaigns",
                    "Protect current growth by monitoring fulfillment capacity and stock levels"]
    flat = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, "Unknown", 0.0, 0)], ctx.schema)
    assert [r.insight for r in R.insights(flat).collect()] == ["Revenue is broadly stable"]
    assert [r.recommendation for r in R.recommendations(flat).collect()] == [
        "Continue monitoring revenue, category mix, and anomaly signals"]


def test_signal_context_defaults_on_empty(spark):
    ctx = G.signal_context(sample(spark), state="none").first()
    assert ctx.top_category == "Unknown" and ctx.top_category_share == 0.0 and ctx.anomaly_count == 0
    assert ctx.last_7_avg == 0.0


def test_anomaly_count_zero_variance(spark):
    rows = [row(f"o{i}", "c", "p", f"2024-03-{i:02d}", 5) for i in range(1, 10)]
    assert G.anomaly_count(clean_frame(spark, rows)).first().anomaly_count == 0


def test_approximate_segments(spark):
    """Thresholds from the sketch: ranks within the stated error, segments close to the exact ones."""
    rows = [row(f"o{k}", f"c{k}", "p", "2024-01-01", (k * 7919) % 20011) for k in range(20000)]
    oc = clean_frame(spark, rows).repartition(5)
    spend = M.customer_spend(oc)
    values = sorted(float(r.total_spend) for r in spend.collect())
    th = M.segment_thresholds(spend, approx=True).first()
    for got, q in ((th.p25, 0.25), (th.p75, 0.75)):
        assert abs(sum(v <= got for v in values) / len(values) - q) <= M.RANK_ERROR
    exact = {r.segment: r["count"] for r in M.customer_segments(oc).collect()}
    near = {r.segment: r["count"] for r in M.customer_segments(oc, approx=True).collect()}
    assert exact.keys() == near.keys() and all(abs(exact[s] - near[s]) <= 2 * M.RANK_ERROR * len(values) for s in exact)
    none = M.customer_segments(oc.limit(0), approx=True).collect()
    assert [r["count"] for r in none] == [0, 0, 0]
