"""lexspan: document-clause analytics on Spark, with DataFrames throughout."""
