"""Set-wise analytics over company financial facts and filings, on Spark DataFrames."""
