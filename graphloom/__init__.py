"""A property-graph and analytics engine on Spark DataFrames."""
