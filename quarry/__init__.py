"""quarry: search and ranking over file catalogues, as Spark DataFrames."""
