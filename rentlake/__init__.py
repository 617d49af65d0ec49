"""rentlake: set-based rental-listing analytics on Spark DataFrames."""
