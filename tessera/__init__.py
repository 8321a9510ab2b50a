"""tessera: annotated-text analytics expressed as Spark DataFrames."""
