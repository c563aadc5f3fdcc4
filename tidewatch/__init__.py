"""Change points in the dependence between two series, on Spark."""
