"""Customer analytics on hand-computed frames (T5, T11, T12, T13, T18; midpoint; floored days)."""

from __future__ import annotations

import math

from shoplens.operators import advanced as A
from shoplens.operators.clean import prepare_orders
from tests.frames import clean_frame, row


def orders(spark, rows):
    return prepare_orders(clean_frame(spark, rows))


def test_cohort_retention_dense_and_period0(spark):
    rows = [row("o1", "a", "p", "2024-01-05", 1), row("o2", "b", "p", "2024-01-07", 1),
            row("o3", "a", "p", "2024-03-01", 1), row("o4", "c", "p", "2024-02-01", 1)]
    out = {r.cohort_month: r.retention for r in A.cohort_retention(orders(spark, rows)).collect()}
    assert out == {"2024-01": [100.0, 0.0, 50.0], "2024-02": [100.0, 0.0, 0.0]}


def test_decomposition_midpoint_goes_previous(spark):
    # span 2024-01-01 .. 2024-01-03: midpoint 01-02 00:00 belongs to "previous"
    rows = [row("o1", "a", "p", "2024-01-01", 100), row("o2", "b", "p", "2024-01-02", 100),
            row("o3", "c", "p", "2024-01-03", 300)]
    r = A.revenue_decomposition(orders(spark, rows)).first()
    # previous: 2 orders, 200; current: 1 order, 300
    assert r.total_change_pct == 50.0
    assert r.order_contribution_pct == -50.0           # (1-2)*100/200
    assert r.aov_contribution_pct == 100.0             # 1*(300-100)/200
    same = A.revenue_decomposition(orders(spark, rows[:1])).first()
    assert (same.total_change_pct, same.order_contribution_pct, same.aov_contribution_pct) == (0.0, 0.0, 0.0)


def test_churn_intraday_not_over_30_days(spark):
    rows = [
        # customer a: last order 30 days 5 hours before the max date -> 30 days, not at risk
        row("a1", "a", "p", "2024-01-01 00:00:00", 50), row("a0", "a", "p", "2023-12-20 00:00:00", 10),
        # customer b: 40 days before, active in the previous window, nothing now -> at risk
        row("b1", "b", "p", "2023-12-22 05:00:00", 80),
        row("z", "z", "p", "2024-01-31 05:00:00", 1),
    ]
    cust = {r.customer_id: r for r in A.churn_customers(orders(spark, rows)).collect()}
    assert cust["a"].days_since_last_purchase == 30 and not cust["a"].is_high_risk
    assert cust["b"].days_since_last_purchase == 40 and cust["b"].is_high_risk
    risk = A.churn_risk(orders(spark, rows)).first()
    assert risk.high_risk_customers == 1 and risk.potential_revenue_loss == 80.0


def test_ltv_components(spark):
    rows = [row("o1", "a", "p1", "2024-01-01", 100), row("o1", "a", "p2", "2024-01-01", 100),
            row("o2", "a", "p1", "2024-01-11", 50), row("o3", "b", "p1", "2024-01-01 08:00:00", 70)]
    out = {r.customer_id: r for r in A.customer_ltv(orders(spark, rows), 10).collect()}
    assert out["a"].total_orders == 2 and out["a"].active_days == 10 and out["a"].ltv == 250.0
    assert out["b"].active_days == 1 and out["b"].ltv == 70.0
    assert [r.customer_id for r in A.customer_ltv(orders(spark, rows), 1).collect()] == ["a"]


def test_root_cause_ties_and_nan_baseline(spark):
    rows = [row(f"d{i}", "c", "p", f"2024-01-{i:02d}", 10, cat="base", state="S") for i in range(1, 11)]
    rows += [row("x1", "c", "p", "2024-01-05", 500, cat="zeta", state="T"),
             row("x2", "c", "p", "2024-01-05", 500, cat="alpha", state="T")]
    out = A.anomaly_root_cause(orders(spark, rows), dates=["2024-01-05 13:00:00"]).collect()
    assert len(out) == 1
    r = out[0]
    assert r.top_category == "alpha"          # tie 500 / 500 -> smallest label
    assert r.category_increase_pct is None    # alpha sold on no other day
    assert r.top_state == "T" and r.state_increase_pct is None
    out2 = A.anomaly_root_cause(orders(spark, rows), dates=["2024-01-03"]).first()
    assert out2.top_category == "base" and out2.category_increase_pct == 0.0
    assert A.anomaly_root_cause(orders(spark, rows), dates=["2030-01-01"]).count() == 0
    auto = A.anomaly_root_cause(orders(spark, rows)).collect()
    assert [str(r.date) for r in auto] == ["2024-01-05"]
    assert not math.isnan(auto[0].state_increase_pct or 0.0)


def test_root_cause_baseline_excludes_only_that_day(spark):
    rows = [row("a", "c", "p", "2024-01-01", 100, cat="k"), row("b", "c", "p", "2024-01-02", 300, cat="k"),
            row("c", "c", "p", "2024-01-03", 500, cat="k")]
    r = A.anomaly_root_cause(orders(spark, rows), dates=["2024-01-03"]).first()
    assert r.category_increase_pct == 150.0   # 500 vs mean(100, 300)


def test_observed_days_agree_with_root_cause_default(spark):
    rows = [row(f"d{i}", "c", "p", f"2024-01-{i:02d}", 10) for i in range(1, 21)]
    rows.append(row("big", "c", "p", "2024-01-07", 900))
    o = orders(spark, rows)
    days = sorted(str(r.order_day) for r in A.observed_anomaly_days(o).collect())
    assert days == ["2024-01-07"]
    assert [str(r.date) for r in A.anomaly_root_cause(o).collect()] == days
