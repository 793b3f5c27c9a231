"""codeloom: curation of coded free-text records and evaluation of predictions on them, as Spark DataFrames."""
