"""glyphgrid: exact text-index and substring analytics on PySpark DataFrames."""
