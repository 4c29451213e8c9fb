"""Longitudinal cohort analytics on the Spark DataFrame API.

Layout: ``functions`` (Column helpers), ``operators`` (DataFrame to DataFrame),
``sources`` (readers and sinks), ``plans`` (composite cohort operators),
``models`` (clustered logistic regression) and ``queries`` (registered queries
with their SQL oracles).
"""
