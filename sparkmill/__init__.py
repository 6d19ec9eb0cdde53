"""sparkmill: dataset-quality and classifier-evaluation operators on Spark DataFrames."""
