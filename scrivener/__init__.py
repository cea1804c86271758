"""Entity mining and ranking on Spark, with training-data operators beside it."""
