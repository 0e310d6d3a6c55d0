"""leafpress: document processing and training-data operators on Spark DataFrames."""
