"""offerlake: offers, places and evidence as Spark DataFrames."""
