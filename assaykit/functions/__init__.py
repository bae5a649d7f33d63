"""Column-level building blocks: hashing, ordered folds, quantiles, joins, metrics."""
