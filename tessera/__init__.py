"""Evidence-grounded document analysis on Spark DataFrames."""
