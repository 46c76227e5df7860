"""pageloom: analytics over scanned pages, page text and crawled documents on Spark DataFrames."""
