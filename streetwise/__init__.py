"""Address linkage on Spark: parse, block, score and rank free-text addresses."""
