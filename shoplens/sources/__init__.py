"""Sources and sinks: raw tables, the clean table store, batches, upsert."""
