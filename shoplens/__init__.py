"""shoplens — e-commerce order analytics as Spark DataFrame operators.

Every public operator is a pure ``DataFrame -> DataFrame`` function (or a
small composition of them). Nothing inside an operator collects rows to the
driver; the caller decides when to act.

Sub-packages:

* ``sources``   — raw CSV / test-table readers, clean-table store, batch
                  cutting and keyed upsert.
* ``operators`` — cleaning, filters, validation, SQL-style marts, signals,
                  rule texts, customer analytics, presentation shaping.
* ``functions`` — column-level helpers (dates, money, rounding, numbering).
* ``plans``     — multi-step plans: daily time series, forecasting, the
                  marts bundle.
* ``streaming`` — Structured Streaming ingest with per-micro-batch upsert.
"""

__version__ = "0.1.0"
