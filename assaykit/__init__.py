"""assaykit: evidence about model predictions and training data, computed on Spark."""
