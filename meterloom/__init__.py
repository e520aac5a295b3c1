"""meterloom: metrics aggregation and metric/text data processing on Spark DataFrames."""
