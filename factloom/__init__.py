"""Document fact extraction and verification on Spark DataFrames."""
