"""Evidence and event analytics as Spark DataFrames."""
