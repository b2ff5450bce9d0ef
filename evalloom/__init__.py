"""evalloom: scoring, consistency and dataset-building operators on Spark DataFrames."""
