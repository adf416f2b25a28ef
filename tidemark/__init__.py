"""Event-broker analytics and corpus preparation on Spark DataFrames."""
