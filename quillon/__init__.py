"""quillon: late-interaction retrieval, triage and evaluation on Spark DataFrames."""
