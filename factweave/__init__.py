"""Program-fact analytics and corpus preparation on Spark DataFrames."""
