"""strata: layered batch analytics on Spark DataFrames."""
