"""Panel analytics and corpus preparation on PySpark DataFrames."""
