"""tidelane: gridded ocean forecasts and marine route graphs on Spark DataFrames."""
