"""Record linkage, record fusion and interval algebra over messy catalogs, on Spark DataFrames."""
