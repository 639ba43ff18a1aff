"""tessera: hybrid retrieval and text analytics as Spark DataFrames."""
