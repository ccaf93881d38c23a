"""lectern: grounded question answering and corpus preparation on Spark DataFrames."""
