"""Detection forecasting for presence/absence survey data, as Spark jobs."""
