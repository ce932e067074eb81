"""paperloom: document analytics and page algebra on PySpark DataFrames."""
