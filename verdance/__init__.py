"""verdance: Earth-observation time-series analytics expressed as Spark DataFrames."""
