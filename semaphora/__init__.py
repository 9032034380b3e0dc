"""Set-at-a-time analytics over corpora of track-diagram scene documents, on plain Spark DataFrames."""
