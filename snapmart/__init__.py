"""Monthly snapshot analytics on Spark: ingest, cleaning, features, labels, models, monitoring."""
