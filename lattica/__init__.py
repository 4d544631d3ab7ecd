"""lattica: recommendation-graph analytics and corpus operators on Spark DataFrames."""
