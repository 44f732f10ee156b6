"""shelfmark: inventory, linkage and curation of media libraries on Spark.

Every operator takes DataFrames and returns a DataFrame. Nothing is collected
to the driver; state lives in versioned Parquet tables.
"""
