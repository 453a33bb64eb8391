"""quillmill: text-corpus and claim analytics on Spark DataFrames."""
