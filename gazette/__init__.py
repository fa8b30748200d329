"""Release-feed analytics on Spark: parse, dedup, enrich, upsert and search official-statistics releases."""
