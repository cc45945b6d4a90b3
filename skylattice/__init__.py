"""Station-series analytics on Spark: every operator is a lazy DataFrame plan."""
