"""Version-controlled, content-addressed data as Spark DataFrames."""
