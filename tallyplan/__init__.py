"""tallyplan: take-off analytics on Spark DataFrames."""
