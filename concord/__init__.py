"""Analytics over tables held by several parties, on Spark DataFrames."""
