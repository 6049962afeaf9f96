"""codeloom: code intelligence and property-graph analytics on Spark DataFrames."""
