"""Analytics for document knowledge bases on PySpark DataFrames."""
