"""Models and metrics. What a model learns is a few numbers on the driver; rows stay in Spark."""
