"""strophe: verse and document corpora on Spark DataFrames."""
