"""Competition analytics on Spark: marks, races, head-to-heads, features, models and reports as DataFrame plans."""
