"""Contrastive table embedders and predictors: small NumPy steps inside tasks, data movement by Spark."""
