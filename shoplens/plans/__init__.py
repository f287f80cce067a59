"""Multi-step plans: daily series, forecasting, the marts bundle."""
