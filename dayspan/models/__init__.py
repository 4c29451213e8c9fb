"""Clustered logistic regression (generalized estimating equations) as Spark aggregations."""
