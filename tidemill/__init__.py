"""Record-flow analytics on PySpark DataFrames."""
