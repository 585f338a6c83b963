"""Growth-curve analytics and corpus operators on Spark DataFrames."""
