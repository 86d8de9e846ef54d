"""taxaflow: sequence classification and profiling on Spark DataFrames."""
