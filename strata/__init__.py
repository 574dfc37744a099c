"""strata: rule-based, time-stepped data processing on PySpark DataFrames."""
