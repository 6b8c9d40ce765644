"""ledgerline: file-catalog analytics and corpus preparation on PySpark DataFrames."""
