"""gridlens: hourly cell-grid activity analytics on PySpark DataFrames."""
