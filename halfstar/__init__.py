"""Rating-data analytics and offline recommender evaluation on Spark DataFrames."""
