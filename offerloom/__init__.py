"""Job-listing data engine on Spark: parse, normalize, upsert, resolve, search and export listings."""
